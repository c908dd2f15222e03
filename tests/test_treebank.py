"""Treebank tokenisation of sentences worked out from the rules."""

from lumenread.functions import dialect, treebank

#: An apostrophe that an earlier rule has set apart is no longer seen by the rules for more'n, 'tis and 'twas.
SENTENCES = {
    'He said, "It costs $1,000, you know."': "He said , `` It costs $ 1,000 , you know . ''",
    "I wanna go; gimme more'n that, d'ye hear?": "I wan na go ; gim me more ' n that , d ' ye hear ?",
    "We'll say they've (cannot) gone...": "We 'll say they 've -LRB- can not -RRB- gone ...",
    "It's John's, isn't it?": "It 's John 's , is n't it ?",
    "'Tis -- or 'twas -- [not] {so} <far>!": "' Tis -- or ' twas -- -LSB- not -RSB- -LCB- so -RCB- < far > !",
    "Mr. Smith left at 5 p.m.": "Mr. Smith left at 5 p.m .",
    "Cannot, gonna, gotta, lemme": "Can not , gon na , got ta , lem me",
    "a & b @ c # d % e": "a & b @ c # d % e",
    "": "",
    "   ": "",
}


def test_sentences(spark):
    rows = spark.createDataFrame([(t,) for t in SENTENCES] + [(None,)], "text string").select("text", treebank.tokenised(treebank.F.col("text")).alias("tokens")).collect()
    found = {r["text"]: r["tokens"] for r in rows}
    assert found.pop(None) is None
    assert found == SENTENCES


def test_columns_and_sql_agree(spark):
    from lumenread.functions.dialect import SPARK

    spark.createDataFrame([(t,) for t in SENTENCES], "text string").createOrReplaceTempView("sentences_to_tokenise")
    found = spark.sql(f"select text, {treebank.tokenised_sql(SPARK, 'text')} as tokens from sentences_to_tokenise").collect()
    assert {r["text"]: r["tokens"] for r in found} == SENTENCES


def test_groups_pass_over_what_no_rule_changes(spark):
    """Texts of all the rules' characters and words, side by side in every order of chance, come out as by one rule after the other."""
    import random

    draw = random.Random(4)
    parts = ['"', "``", "...", ".", ",", ", 5", ";", "#", "?", "!", "(", ")", "[", "]", "{", "}", "<", ">", "--", "'", " 'll ", "n't ", " cannot ", " d'ye ", " gimme ", " more'n ", " 'tis ", " wanna ", "  ", "ab", " don't ", "é"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(600)] + parts
    spark.createDataFrame([(t,) for t in texts], "text string").createOrReplaceTempView("grouped_sentences")
    by_rule, by_group = treebank.tokenised(treebank.F.col("text")), treebank.F.expr(treebank.tokenised_sql(dialect.SPARK, "text"))
    found = spark.table("grouped_sentences").select(by_rule.alias("a"), by_group.alias("b")).collect()
    assert len(treebank.GROUPS) > 1 and [r["a"] for r in found] == [r["b"] for r in found]
    assert treebank.GROUPS[0][0] == 0 and treebank.GROUPS[-1][1] == len(treebank.RULES) and all(x[1] == y[0] for x, y in zip(treebank.GROUPS, treebank.GROUPS[1:], strict=False))
