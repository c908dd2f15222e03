"""Queries over documents, pages and conversations: n-gram models, sentence features, filters."""

from __future__ import annotations

from lumenread.functions.dialect import Dialect
from lumenread.operators import transitions
from lumenread.plans.query import FrameQuery, SqlQuery

#: Adjacent pairs within a document, with unigram counts and the vocabulary's size.
PAIRS = """
uni as (select word, count(*) as c from {tok} group by word),
bi as (select prev as w1, word as w2, count(*) as c from {seq} where prev is not null group by prev, word),
v as (select count(*) as vocabulary, sum(c) as total from uni)
"""
#: What each pair of neighbours costs, once a pair: every token is joined with it by both words.
COSTS = PAIRS + """,
cost as (select bi.w1, bi.w2, ln((bi.c + 1e0) / (a.c + v.vocabulary)) as fwd, ln((bi.c + 1e0) / (b.c + v.vocabulary)) as bwd from bi join uni a on a.word = bi.w1 join uni b on b.word = bi.w2 cross join v)
"""


def unigram(d: Dialect) -> str:
    return "select word, count(*) as n, count(distinct doc_id) as docs from {tok} group by word"


def bigram(d: Dialect) -> str:
    return f"with {PAIRS} select w1, w2, c as n from bi"


def bigram_across(d: Dialect) -> str:
    """Pairs of the whole token stream, across documents too.

    A document's next one is looked up in its block of ids, the last one's in the blocks' first ones.
    """
    if d.spark:  # ends come from the two rows a document that have them, and pairs are added up once
        return """with ends as (select doc_id, cast(floor(doc_id / 4096e0) as bigint) as block, max(case when prev is null then word end) as first_word, max(case when next is null then word end) as last_word from {seq} where prev is null or next is null group by doc_id),
    heads as (select block, first_word, row_number() over (partition by block order by doc_id) as rn from ends), blocks as (select block, lead(first_word) over (order by block) as next_word from heads where rn = 1),
    s as (select e.last_word as w1, coalesce(lead(e.first_word) over (partition by e.block order by e.doc_id), b.next_word) as w2 from ends e join blocks b on b.block = e.block),
    x as (select prev as w1, word as w2 from {seq} where prev is not null union all select w1, w2 from s where w2 is not null)
    select w1, w2, count(*) as n from x group by w1, w2"""
    return f"""with {PAIRS}, ends as (select doc_id, cast(floor(doc_id / 4096e0) as bigint) as block, max(case when prev is null then word end) as first_word, max(case when next is null then word end) as last_word from {{seq}} group by doc_id),
    heads as (select block, first_word, row_number() over (partition by block order by doc_id) as rn from ends), blocks as (select block, lead(first_word) over (order by block) as next_word from heads where rn = 1),
    s as (select e.last_word as w1, coalesce(lead(e.first_word) over (partition by e.block order by e.doc_id), b.next_word) as w2 from ends e join blocks b on b.block = e.block),
    x as (select w1, w2, c from bi union all select w1, w2, 1 as c from s where w2 is not null)
    select w1, w2, cast(sum(c) as bigint) as n from x group by w1, w2"""


def cond_prob(d: Dialect) -> str:
    return f"with {PAIRS} select w1, w2, round(c / cast(sum(c) over (partition by w1) as double), 9) as p from bi"


def transition_probs(d: Dialect) -> str:
    """Smoothed log probability of each word given the one before and given the one after."""
    return f"""with {COSTS} select s.doc_id, s.pos, round(case when s.prev is null then ln(1e0 / v.vocabulary) else f.fwd end, 6) as fwd, round(case when s.next is null then ln(1e0 / v.vocabulary) else b.bwd end, 6) as bwd
    from {{seq}} s cross join v left join cost f on f.w1 = s.prev and f.w2 = s.word left join cost b on b.w1 = s.word and b.w2 = s.next"""


def lexical_surprisal(d: Dialect) -> str:
    return f"""with {COSTS}, x as (select s.doc_id, coalesce(-c.fwd, 0e0) as h from {{seq}} s left join cost c on c.w1 = s.prev and c.w2 = s.word)
    select doc_id, count(*) as n_words, round(avg(h), 6) as mean_surprisal, round(max(h), 6) as max_surprisal, round(sum(h), 4) as sum_surprisal from x group by doc_id"""


def next_entropy(d: Dialect) -> str:
    return f"""with {PAIRS}, p as (select w1, c / cast(sum(c) over (partition by w1) as double) as p from bi)
    select w1 as word, count(*) as followers, round(-sum(p * ln(p)), 6) as entropy from p group by w1"""


def entropy_reduction(d: Dialect) -> str:
    return f"""with {PAIRS}, p as (select w1, c / cast(sum(c) over (partition by w1) as double) as p from bi),
    h as (select w1, -sum(p * ln(p)) as h from p group by w1),
    k as (select u.word, coalesce(h.h, ln(cast(v.vocabulary as double))) as h from uni u cross join v left join h on h.w1 = u.word),
    fall as (select bi.w1, bi.w2, greatest(0e0, a.h - b.h) as fall from bi join k a on a.word = bi.w1 join k b on b.word = bi.w2)
    select s.doc_id, count(*) as n, round(sum(coalesce(f.fall, 0)), 4) as reduction from {{seq}} s left join fall f on f.w1 = s.prev and f.w2 = s.word group by s.doc_id"""


def word_frequency_log(d: Dialect) -> str:
    return f"with {PAIRS} select l.word, round(ln(coalesce(u.c, 0) / cast(v.total as double) + 1e-9), 6) as log_freq from {{lex}} l cross join v left join uni u on u.word = l.word"


def sentence_split(d: Dialect) -> str:
    return "select doc_id, sid, sentence from {sent}"


def sentence_length(d: Dialect) -> str:
    return f"""with x as (select doc_id, sid, {d.count_matches('sentence', chr(92) + 'S+')} as words from {{sent}})
    select doc_id, count(*) as sentences, round(avg(words), 6) as mean_words, max(words) as longest, min(words) as shortest from x group by doc_id"""


def word_stats(d: Dialect) -> str:
    return """select doc_id, count(*) as n_words, round(avg(length(word)), 6) as mean_len, max(length(word)) as longest, count(distinct word) as types,
    round(count(distinct word) / cast(count(*) as double), 6) as ttr from {tok} group by doc_id"""


def punct_marks(d: Dialect) -> str:
    return f"""select doc_id, {d.count_matches('text', '[.]')} as stops, {d.count_matches('text', ',')} as commas, {d.count_matches('text', '[!?]')} as calls,
    {d.count_matches('text', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]')} as marks, {d.count_matches('text', chr(92) + 'p{N}')} as digits from {{documents}}"""


def html_tokens(d: Dialect) -> str:
    if d.spark:
        tags = "select page_id, explode(regexp_extract_all(lower(html), r'<([a-z][a-z0-9]*)', 1)) as tag from {pages}"
    else:
        tags = "select page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) as tag from {pages}"
    return f"with t as ({tags}) select page_id, tag, count(*) as n from t group by page_id, tag"


def page_words(d: Dialect) -> str:
    plain = d.replace("html", "<[^>]*>", " ")
    return f"select page_id, length({plain}) as chars, {d.count_matches(plain, chr(92) + 'p{L}+')} as words from {{pages}}"


def clean_sentences(d: Dialect) -> str:
    s = chr(92)
    words, letters, other = d.count_matches("sentence", s + "S+"), d.count_matches("sentence", s + "p{L}+"), d.count_matches("sentence", "[0-9|#$%&*<>]")
    return f"""with x as (select doc_id, sid, sentence, {words} as words, {letters} as alpha, {other} as odd from {{sent}})
    select doc_id, sid, case when words between 4 and 40 and odd = 0 and alpha >= 0.8 * words and not {d.matches('sentence', '^[,;:)]')} then 1 else 0 end as clean from x"""


def verse_filter(d: Dialect) -> str:
    s = chr(92)
    if d.spark:
        lines = "filter(split(text, r'\\n'), x -> trim(x) <> '')"
        counts = f"transform({lines}, x -> size(regexp_extract_all(x, r'{s}S+', 0)))"
        inner = "exists(slice(c, 2, greatest(size(c) - 2, 0)), x -> x < 4)"
        most, n = "array_max(c)", "size(c)"
    else:
        lines = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
        counts = f"list_transform({lines}, lambda x: len(regexp_extract_all(x, '{s}S+')))"
        inner = "len(list_filter(c[2:len(c) - 1], lambda x: x < 4)) > 0"
        most, n = "list_max(c)", "len(c)"
    return f"""with x as (select doc_id, {counts} as c from {{documents}})
    select doc_id, {n} as n_lines, case when {n} >= 2 and ({most} < 5 or {inner}) then 1 else 0 end as verse from x"""


def latin_share(d: Dialect) -> str:
    return f"""select doc_id, round({d.count_matches('text', '[A-Za-z]')} / cast(greatest(length(text), 1) as double), 6) as latin,
    round({d.count_matches('text', '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} / cast(greatest(length(text), 1) as double), 6) as beyond_ascii from {{documents}}"""


def known_word_ratio(d: Dialect) -> str:
    return """select t.doc_id, count(*) as n_words, round(avg(case when l.word is null then 0e0 else 1e0 end), 6) as known,
    case when count(*) >= 20 and avg(case when l.word is null then 0e0 else 1e0 end) >= 0.6 then 1 else 0 end as usable
    from {tok} t left join {lex} l on l.word = t.word group by t.doc_id"""


def usable_pages(d: Dialect, contents: str = "license", least_words: int = 20, least_known: float = 0.6) -> str:
    """Pages of books (documents of a source) after the book's first that holds the heading of its contents, with words enough and known ones enough."""
    share = "avg(case when l.word is null then 0e0 else 1e0 end)"
    if d.spark:
        return f"""with w as (select o.source, t.doc_id, count(*) as words, {share} as known, max(case when t.word = '{contents}' then 1 else 0 end) as heading from {{tok}} t join {{documents}} o on o.doc_id = t.doc_id left join {{lex}} l on l.word = t.word group by o.source, t.doc_id),
    p as (select *, min(case when heading = 1 then doc_id end) over (partition by source) as contents from w)
    select source, doc_id, words, round(known, 6) as known, coalesce(contents, -1) as contents, case when doc_id > coalesce(contents, -1) and words >= {least_words} and known >= {least_known} then 1 else 0 end as usable from p"""
    return f"""with t as (select source, doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') as ws from documents), c as (select source, min(doc_id) as contents from t where list_contains(ws, '{contents}') group by source), k as (select list(word) as ks from {{lex}}),
    n as (select source, doc_id, len(ws) as words, len(list_filter(ws, lambda w: list_contains(ks, w))) as hits from t cross join k where len(ws) > 0)
    select n.source, doc_id, words, round(hits / cast(words as double), 6) as known, coalesce(contents, -1) as contents, case when doc_id > coalesce(contents, -1) and words >= {least_words} and hits / cast(words as double) >= {least_known} then 1 else 0 end as usable from n left join c on c.source = n.source"""


def normalise_sentence(d: Dialect) -> str:
    s = chr(92)
    step = d.replace("sentence", s + "s+", " ")
    step = d.replace(step, "^[0-9]+[.)] *", "")
    step = d.replace(step, '[“”"«»]', "")
    return f"select doc_id, sid, trim({step}) as sentence from {{sent}}"


def complex_eligible(d: Dialect) -> str:
    s = chr(92)
    return f"""with x as (select doc_id, sid, sentence, {d.count_matches('sentence', s + 'S+')} as words from {{sent}})
    select doc_id, sid, words from x where words between 10 and 30 and not {d.matches('sentence', '[0-9()|#$%&*]')}"""


def stimulus_filter(d: Dialect) -> str:
    s = chr(92)
    return f"""with x as (select sentence, min(doc_id) as doc_id, count(*) as copies from {{sent}} group by sentence)
    select doc_id, sentence from x where copies = 1 and {d.count_matches('sentence', s + 'S+')} between 6 and 16 and not {d.matches('sentence', '[^' + s + 'p{L}., ]')}"""


def text_mean_features(d: Dialect) -> str:
    s = chr(92)
    return f"""with x as (select doc_id, sid, {d.count_matches('sentence', s + 'S+')} as words, length(sentence) as chars, {d.count_matches('sentence', ',')} as commas from {{sent}})
    select doc_id, count(*) as n_sentences, round(avg(words), 6) as words, round(avg(chars / cast(greatest(words, 1) as double)), 6) as word_len, round(avg(commas), 6) as commas from x group by doc_id"""


def context_budget(d: Dialect, budget: int = 120, turns: int = 5) -> str:
    """The last turns before each, at most some of them, that fit a budget of words; the first that overflows ends the context.

    Turns from b on fit before turn n if the words before n less those before b are within the budget: a range of running sums.
    """
    s = chr(92)
    return f"""with x as (select conv_id, turn, {d.count_matches('text', s + 'S+')} as words from {{conversations}}),
    y as (select conv_id, turn, words, cast(coalesce(sum(words) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as before from x),
    z as (select conv_id, turn, before, count(*) over fits as n, min(before) over fits as since, row_number() over (partition by conv_id, before order by turn desc) as own, before - coalesce(lag(before, {turns}) over (partition by conv_id order by turn), 0) as lately from y
        window fits as (partition by conv_id order by before range between {budget} preceding and current row))
    select conv_id, turn, least(n - own, {turns}) as context_turns, case when n = own then 0 else least(before - since, lately) end as context_words from z"""


def section_carry(d: Dialect) -> str:
    """The last heading seen, carried to the sentences after it."""
    last = "last_value(h{}) over (partition by doc_id order by sid rows unbounded preceding)".format(", true" if d.spark else " ignore nulls")
    return f"""with x as (select doc_id, sid, case when length(sentence) <= 24 then sentence end as h from {{sent}})
    select doc_id, sid, coalesce({last}, '') as section from x"""


def mark_split(d: Dialect) -> str:
    s = chr(92)
    get = (lambda p, g: f"regexp_extract(w, r'{p}', {g})") if d.spark else (lambda p, g: f"regexp_extract(w, '{p}', {g})")
    words = (f"select doc_id, explode(split(text, r'{s}s+')) as w from {{documents}}" if d.spark else f"select doc_id, unnest(regexp_split_to_array(text, '{s}s+')) as w from {{documents}}")
    pattern = f"^([^{s}p{{L}}{s}p{{N}}]*)(.*?)([^{s}p{{L}}{s}p{{N}}]*)$"
    return f"""with x as ({words}), y as (select {get(pattern, 1)} as opening, {get(pattern, 3)} as closing from x where w <> '')
    select opening, closing, count(*) as n from y group by opening, closing"""


def punct_tokens(d: Dialect) -> str:
    s = chr(92)
    spaced = f"regexp_replace(sentence, r'([.,;:!?])', ' $1 ')" if d.spark else f"regexp_replace(sentence, '([.,;:!?])', ' {s}1 ', 'g')"
    return f"select doc_id, sid, trim({d.replace(spaced, s + 's+', ' ')}) as tokenised from {{sent}}"


def pos_surprisal(d: Dialect) -> str:
    tag = "case when word is null then null when length(word) <= 2 then 'short' when length(word) <= 5 then 'mid' when length(word) <= 9 then 'long' else 'very' end"
    return f"""with s as (select doc_id, {tag} as tag, {tag.replace("word", "prev")} as prev from {{seq}}),
    c as (select prev, tag, count(*) as n from s where prev is not null group by prev, tag),
    p as (select prev, tag, n / cast(sum(n) over (partition by prev) as double) as p from c)
    select s.doc_id, round(sum(case when s.prev is null then 0 else -ln(greatest(coalesce(p.p, 0), 1e-12)) end), 4) as pos_surprisal from s left join p on p.prev = s.prev and p.tag = s.tag group by s.doc_id"""


def vocabulary_growth(d: Dialect) -> str:
    return """with f as (select lang, word, min(doc_id) as first_doc from {tok} group by lang, word)
    select lang, cast(floor(first_doc / 100e0) as bigint) as block, count(*) as new_words from f group by lang, cast(floor(first_doc / 100e0) as bigint)"""


def lookup_tiers(d: Dialect) -> str:
    """A lexicon first, a guess by ending only for what it misses."""
    return """with w as (select word, count(*) as n from {tok} group by word)
    select case when l.word is not null then 'lexicon' when w.word like '%ing' or w.word like '%ion' or w.word like '%en' then 'guess' else 'none' end as tier,
    count(*) as types, cast(sum(w.n) as bigint) as tokens from w left join {lex} l on l.word = w.word
    group by case when l.word is not null then 'lexicon' when w.word like '%ing' or w.word like '%ion' or w.word like '%en' then 'guess' else 'none' end"""


def top_words(d: Dialect) -> str:
    return """with c as (select lang, word, count(*) as n from {tok} group by lang, word), r as (select *, row_number() over (partition by lang order by n desc, word) as rn from c)
    select lang, word, n, rn from r where rn <= 20"""


def ordered_unique(d: Dialect) -> str:
    if d.spark:
        return "select item_id, size(array_distinct(split(lower(text), r'[^a-z]+'))) as distinct_words, element_at(array_distinct(split(lower(text), r'[^a-z]+')), 1) as first_word from {benchmark}"
    return "select item_id, len(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) as distinct_words, regexp_split_to_array(lower(text), '[^a-z]+')[1] as first_word from {benchmark}"


def turn_concat(d: Dialect) -> str:
    return """select conv_id, role, count(*) as turns, min(turn) as first_turn, max(turn) as last_turn, cast(sum(length(text)) as bigint) as chars from {conversations} group by conv_id, role"""


def number_cascade(d: Dialect) -> str:
    """Text as a whole number, else as a number, else as text."""
    kind = "case when try_cast(v as bigint) is not null and v not like '%.%' then 'int' when try_cast(v as double) is not null then 'float' else 'text' end"
    source = "select event_id, case when event_id % 3 = 0 then cast(user_id as {t}) when event_id % 3 = 1 then concat(cast(user_id as {t}), '.5') else event_type end as v from {{events}}"
    source = source.format(t="string" if d.spark else "varchar")
    return f"with x as ({source}) select {kind} as kind, count(*) as n from x group by {kind}"


QUERIES = {f.__name__: SqlQuery(f) for f in (
    unigram, bigram, bigram_across, cond_prob, next_entropy, word_frequency_log, sentence_split,
    sentence_length, word_stats, punct_marks, html_tokens, page_words, clean_sentences, verse_filter, latin_share, known_word_ratio, usable_pages, normalise_sentence,
    complex_eligible, stimulus_filter, text_mean_features, context_budget, section_carry, mark_split, punct_tokens, pos_surprisal,
    vocabulary_growth, lookup_tiers, top_words, ordered_unique, turn_concat, number_cascade)}
QUERIES["transition_probs"] = FrameQuery(transition_probs, transitions.transitions, ("documents",))
QUERIES["lexical_surprisal"] = FrameQuery(lexical_surprisal, transitions.surprisals, ("seq",))
QUERIES["entropy_reduction"] = FrameQuery(entropy_reduction, transitions.falls, ("seq",))
FRAMES: dict = {}
