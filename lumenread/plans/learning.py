"""Registered fits: linear models of prices, rankers and classifiers, and their normal equations in SQL.

The rows are all lineitems: the target is the price, the features what else is numeric, the label
whether the line was returned. Oracles solve the same equations by an LDL decomposition that is
written out column by column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenread.functions.dialect import Dialect
from lumenread.operators import learn
from lumenread.operators.gaze import reading_measures
from lumenread.plans.gaze import MEASURES
from lumenread.plans.query import SqlQuery
from lumenread.plans.statistics import numbered
from lumenread.sources import tables

FEATURES = ["x1", "x2", "x3", "x4"]
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
ROWS = """rows_ as (select l_orderkey, l_returnflag, case when l_returnflag = 'R' then 1e0 else 0e0 end as y, l_extendedprice / 1000e0 as x0,
    l_quantity as x1, l_discount * 100 as x2, l_tax * 100 as x3, cast(l_linenumber as double) as x4 from {lineitem})"""
#: Both Newton's methods are at rest long before so many steps.
STEPS = 9


def example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), (F.col("l_extendedprice") / 1000).alias("x0"),
        F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("x2"), (F.col("l_tax") * 100).alias("x3"), F.col("l_linenumber").cast("double").alias("x4"))


def moment_columns(names: list[str], where: str = "") -> str:
    """Sums of products of 1 and the named columns: s_i_j."""
    terms = ["1e0", *names]
    return ", ".join(f"sum({a} * {b}{where}) as s_{i}_{j + i}" for i, a in enumerate(terms) for j, b in enumerate(terms[i:]))


def moment_names(n: int) -> list[str]:
    return [f"s_{i}_{j}" for i in range(n) for j in range(i, n)]


def at(i: int, j: int) -> str:
    return f"s_{min(i, j)}_{max(i, j)}"


def solved(name: str, source: str, keep: str, n: int, a: Callable[[int, int], str], b: Callable[[int], str]) -> str:
    """Relations that solve a symmetric system for each row of source; the last, name, has keep and w0 to w{n-1}."""
    out, layer = [], 0

    def add(columns: str, first: bool = False) -> None:
        nonlocal layer
        before = source if first else f"{name}_{layer}"
        layer += 1
        out.append(f"{name}_{layer} as (select {keep if first else '*'}, {columns} from {before})")

    add(", ".join([f"{a(i, j)} as a_{i}_{j}" for i in range(n) for j in range(i + 1)] + [f"{b(i)} as b_{i}" for i in range(n)]), True)
    for j in range(n):
        add(" - ".join([f"a_{j}_{j}", *[f"l_{j}_{k} * l_{j}_{k} * d_{k}" for k in range(j)]]) + f" as d_{j}")
        if j < n - 1:
            add(", ".join("(" + " - ".join([f"a_{i}_{j}", *[f"l_{i}_{k} * l_{j}_{k} * d_{k}" for k in range(j)]]) + f") / d_{j} as l_{i}_{j}" for i in range(j + 1, n)))
    for i in range(n):
        add(" - ".join([f"b_{i}", *[f"l_{i}_{k} * y_{k}" for k in range(i)]]) + f" as y_{i}")
    for i in reversed(range(n)):
        add(" - ".join([f"y_{i} / d_{i}", *[f"l_{k}_{i} * w{k}" for k in range(i + 1, n)]]) + f" as w{i}")
    out.append(f"{name} as (select {keep}, {', '.join(f'w{i}' for i in range(n))} from {name}_{layer})")
    return ",\n".join(out)


def ridge_relations(name: str, source: str, keep: str, n: int, alpha: str) -> str:
    """Weights w0.. of n features and the intercept from a relation of moments, the target's last."""
    t = n + 1
    centred = lambda i, j: f"({at(i, j)} - {at(0, i)} * {at(0, j)} / s_0_0)"
    body = solved(f"{name}_w", source, keep, n, lambda i, j: centred(i + 1, j + 1) + (f" + {alpha}" if i == j else ""), lambda i: centred(i + 1, t))
    intercept = " - ".join([f"{at(0, t)} / s_0_0", *[f"w{i} * {at(0, i + 1)} / s_0_0" for i in range(n)]])
    return f"""{body},
{name} as (select *, {intercept} as c from {name}_w)"""


def r2_of(n: int, m: str = "") -> str:
    """R squared of c and w0.. on the moments of a relation m."""
    t = n + 1
    w = ["-c", *[f"-w{i}" for i in range(n)], "1e0"]
    m = f"{m}." if m else ""
    sse = " + ".join(f"{'2 * ' if i != j else ''}({w[i]}) * ({w[j]}) * {m}{at(i, j)}" for i in range(t + 1) for j in range(i, t + 1))
    return f"1 - ({sse}) / ({m}{at(t, t)} - {m}{at(0, t)} * {m}{at(0, t)} / {m}s_0_0)"


def moment_keep(n: int, *more: str) -> str:
    return ", ".join([*more, *moment_names(n + 2)])


def alphas_sql(alphas: tuple[float, ...] = ALPHAS) -> str:
    return "(" + " union all ".join(f"select {a}e0 as alpha" for a in alphas) + ") q"


def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and R squared for each alpha."""
    m = learn.matrix(learn.moments(example(spark, sf_dir), FEATURES, "x0").first()["moments"])
    out = []
    for alpha in ALPHAS:
        intercept, weights = learn.ridge(m, alpha)
        r2 = round(learn.r_squared(m, intercept, weights), 6)
        out += [(alpha, t, round(float(w), 6), r2) for t, w in zip(["intercept", *FEATURES], [intercept, *weights], strict=True)]
    return spark.createDataFrame(out, "alpha double, term string, weight double, r2 double")


def ridge_fit_sql(d: Dialect) -> str:
    n = len(FEATURES)
    terms = " union all ".join(f"select alpha, '{t}' as term, round({c}, 6) as weight, round(r2, 6) as r2 from z" for t, c in zip(["intercept", *FEATURES], ["c", *[f"w{i}" for i in range(n)]], strict=True))
    return f"""with {ROWS}, m as (select {moment_columns([*FEATURES, "x0"])} from rows_), ma as (select m.*, alpha from m cross join {alphas_sql()}),
    {ridge_relations("f", "ma", moment_keep(n, "alpha"), n, "alpha")}, z as (select *, {r2_of(n)} as r2 from f) {terms}"""


def ridge_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha chosen on the development part, the fit on training and development, scored on the test part."""
    parts = learn.moments(example(spark, sf_dir).withColumn("part", F.expr(PART_SPARK)), FEATURES, "x0", ["part"]).collect()
    m = {r["part"]: learn.matrix(r["moments"]) for r in parts}
    alpha = learn.best_alpha(m["train"], m["dev"], ALPHAS)
    intercept, weights = learn.ridge(m["train"] + m["dev"], alpha)
    return spark.createDataFrame([(alpha, int(m["test"][0, 0]), round(learn.r_squared(m["test"], intercept, weights), 6))], "alpha double, n_test long, r2 double")


def part_of(d: Dialect) -> str:
    u = d.uniform("'part'", "l_orderkey")
    return f"case when {u} < 0.6 then 'train' when {u} < 0.8 then 'dev' else 'test' end"


PART_SPARK = part_of(Dialect(True))


def ridge_choice_sql(d: Dialect) -> str:
    n = len(FEATURES)
    both = ", ".join(f"tr.{c} + dv.{c} as {c}" for c in moment_names(n + 2))
    dev = ", ".join(f"dv.{c} as {c}" for c in moment_names(n + 2))
    return f"""with {ROWS}, m as (select {part_of(d)} as part, {moment_columns([*FEATURES, "x0"])} from rows_ group by 1),
    tr as (select * from m where part = 'train'), dv as (select * from m where part = 'dev'), te as (select * from m where part = 'test'),
    ma as (select tr.*, alpha from tr cross join {alphas_sql()}), {ridge_relations("f", "ma", moment_keep(n, "alpha"), n, "alpha")},
    s as (select f.alpha, round({r2_of(n, "dv")}, 12) as r2 from f cross join dv), best as (select alpha from s order by r2 desc, alpha limit 1),
    b as (select alpha, {both} from tr cross join dv cross join best), {ridge_relations("g", "b", moment_keep(n, "alpha"), n, "alpha")}
    select g.alpha, cast(te.s_0_0 as bigint) as n_test, round({r2_of(n, "te")}, 6) as r2 from g cross join te"""


def cv_sql(rows: str, group: str, names: list[str], alphas: str) -> str:
    """Relation z: R squared of each group and alpha, fitted on the other groups."""
    n = len(names)
    rest = ", ".join(f"t.{c} - p.{c} as {c}" for c in moment_names(n + 2))
    total = ", ".join(f"sum({c}) as {c}" for c in moment_names(n + 2))
    return f"""p as (select {group} as part, {moment_columns([*names, "x0"])} from {rows} group by 1), t as (select {total} from p),
    o as (select p.part, alpha, {rest} from p cross join t cross join {alphas}), {ridge_relations("f", "o", moment_keep(n, "part", "alpha"), n, "alpha")},
    z as (select f.part, f.alpha, cast(p.s_0_0 as bigint) as n, {r2_of(n, "p")} as r2 from f join p on p.part = f.part)"""


def ridge_group_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten folds that keep an order's lines together."""
    found = learn.group_cv(example(spark, sf_dir), "l_orderkey", FEATURES, "x0", [0.1, 1.0, 10.0], 10)
    return spark.createDataFrame(found.round({"r2": 6}), "fold int, alpha double, n long, r2 double")


def ridge_group_cv_sql(d: Dialect) -> str:
    fold = f"cast(floor({d.uniform(chr(39) + 'fold' + chr(39), 'l_orderkey')} * 10) as int)"
    return f"with {ROWS}, {cv_sql('rows_', fold, FEATURES, alphas_sql((0.1, 1.0, 10.0)))} select part as fold, alpha, n, round(r2, 6) as r2 from z"


def group_shuffle_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty random splits that keep an order's lines together."""
    found = learn.shuffled_group_cv(example(spark, sf_dir), "l_orderkey", FEATURES, "x0", 1.0)
    return spark.createDataFrame([(k, n, round(r, 6)) for k, n, r in found], "split int, n_test long, r2 double")


def group_shuffle_cv_sql(d: Dialect) -> str:
    n = len(FEATURES)
    fold = f"cast(floor({d.uniform(chr(39) + 'fold' + chr(39), 'l_orderkey')} * 200) as int)"
    test = ", ".join(f"sum(case when tested then {c} else 0 end) as te_{c}" for c in moment_names(n + 2))
    rest = ", ".join(f"sum(case when tested then 0 else {c} end) as {c}" for c in moment_names(n + 2))
    names = ", ".join(f"te_{c} as {c}" for c in moment_names(n + 2))
    return f"""with {ROWS}, p as (select {fold} as shard, {moment_columns([*FEATURES, "x0"])} from rows_ group by 1),
    s as (select split, {d.uniform("'split'", "split", "shard")} < 0.2 as tested, p.* from p cross join {d.series("1", "30", "split")} k),
    b as (select split, {test}, {rest} from s group by split), {ridge_relations("f", "b", moment_keep(n, "split"), n, "1e0")}, te as (select split, {names} from b)
    select cast(f.split as int) as split, cast(te.s_0_0 as bigint) as n_test, round({r2_of(n, "te")}, 6) as r2 from f join te on te.split = f.split"""


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R squared of growing groups of features, from one pass over the rows."""
    whole = learn.matrix(learn.moments(example(spark, sf_dir), FEATURES, "x0").first()["moments"])
    out = []
    for n in range(1, len(FEATURES) + 1):
        keep = [*range(n + 1), len(FEATURES) + 1]
        m = whole[keep][:, keep]
        out.append((n, ", ".join(FEATURES[:n]), round(learn.r_squared(m, *learn.ridge(m, 1.0)), 6)))
    return spark.createDataFrame(out, "n int, features string, r2 double")


def ablation_sql(d: Dialect) -> str:
    parts, ends = [], []
    for n in range(1, len(FEATURES) + 1):
        parts.append(f"m{n} as (select {moment_columns([*FEATURES[:n], 'x0'])} from rows_), {ridge_relations(f'f{n}', f'm{n}', moment_keep(n), n, '1e0')}")
        ends.append(f"select {n} as n, '{', '.join(FEATURES[:n])}' as features, round({r2_of(n)}, 6) as r2 from f{n}")
    return f"with {ROWS}, {', '.join(parts)} {' union all '.join(ends)}"


def polynomial_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one flag out: fits of squares and products on all other flags, scored on it."""
    rows, names = learn.squares(example(spark, sf_dir), FEATURES)
    parts = {r["l_returnflag"]: learn.matrix(r["moments"]) for r in learn.moments(rows, names, "x0", ["l_returnflag"]).collect()}
    whole = sum(parts.values())
    return spark.createDataFrame([(k, int(m[0, 0]), round(learn.r_squared(m, *learn.ridge(whole - m, 1.0)), 5)) for k, m in sorted(parts.items())], "label string, n long, r2 double")


def polynomial_cv_sql(d: Dialect) -> str:
    names = [*FEATURES, *[f"{a}_{b}" for i, a in enumerate(FEATURES) for b in FEATURES[i:]]]
    more = ", ".join(f"{a} * {b} as {a}_{b}" for i, a in enumerate(FEATURES) for b in FEATURES[i:])
    return f"with {ROWS}, poly as (select *, {more} from rows_), {cv_sql('poly', 'l_returnflag', names, alphas_sql((1.0,)))} select part as label, n, round(r2, 5) as r2 from z"


def newton_sql(rows: str, names: list[str], label: str, hold: str, key: str = "", where: str = "", intercept: bool = True, steps: int = STEPS) -> str:
    """Relations of Newton's steps of a penalised logistic fit; the last is w{steps} with key and v0.."""
    x = [*(["1e0"] if intercept else []), *[f"r.{c}" for c in names]]
    n, k = len(x), f"{key}, " if key else ""
    out = [f"w0_ as (select {k}{', '.join(f'0e0 as v{i}' for i in range(n))} from (select {f'distinct {key}' if key else '1 as one'} {f'from {rows}' if key else ''}) q)"]
    held = [("0e0" if intercept and i == 0 else hold) for i in range(n)]
    for step in range(1, steps + 1):
        z = " + ".join(f"v{i} * {c}" for i, c in enumerate(x))
        old = ", ".join(f"v{i}" for i in range(n))
        on = f"on {where}" if where else ""
        join = f"join {rows} r {on}" if where else f"cross join {rows} r"
        values = ", ".join(f"{c} as x{i}_" for i, c in enumerate(x))
        out.append(f"p{step}_ as (select {('o.' + key + ', ') if key else ''}{old}, r.{label} as y_, 1 / (1 + exp(-({z}))) as p_, {values} from w{step - 1}_ o {join})")
        sums = [f"sum((y_ - p_) * x{i}_) as g{i}" for i in range(n)] + [f"sum(p_ * (1 - p_) * x{i}_ * x{j}_) as h_{j}_{i}" for i in range(n) for j in range(i + 1)]
        out.append(f"g{step}_ as (select {k}{', '.join(f'max(v{i}) as v{i}' for i in range(n))}, {', '.join(sums)} from p{step}_ {f'group by {key}' if key else ''})")
        out.append(solved(f"s{step}_", f"g{step}_", f"{k}{old}", n, lambda i, j: f"h_{min(i, j)}_{max(i, j)}" + (f" + {held[i]}" if i == j else ""), lambda i: f"g{i} - {held[i]} * v{i}"))
        out.append(f"w{step}_ as (select {k}{', '.join(f'v{i} + w{i} as v{i}' for i in range(n))} from s{step}_)")
    return ",\n".join(out)


def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = learn.logistic(example(spark, sf_dir), FEATURES, "y")
    return spark.createDataFrame([(t, round(float(w), 6)) for t, w in zip(["intercept", *FEATURES], weights, strict=True)], "term string, weight double")


def logistic_fit_sql(d: Dialect) -> str:
    ends = " union all ".join(f"select '{t}' as term, round(v{i}, 6) as weight from w{STEPS}_" for i, t in enumerate(["intercept", *FEATURES]))
    return f"with {ROWS}, {newton_sql('rows_', FEATURES, 'y', '1e0')} {ends}"


def logistic_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten folds with their share of each label: accuracy of the fit without the fold."""
    rows = learn.stratified_folds(example(spark, sf_dir), "l_returnflag", "l_orderkey")
    return learn.fold_scores(rows, FEATURES, "y", learn.logistic_folds(rows, FEATURES, "y"))


def logistic_cv_sql(d: Dialect) -> str:
    fold = f"cast(floor({d.uniform(chr(39) + 'strata' + chr(39), 'l_returnflag', 'l_orderkey')} * 10) as int)"
    z = " + ".join(["v0", *[f"v{i + 1} * r.{c}" for i, c in enumerate(FEATURES)]])
    return f"""with {ROWS}, folded as (select *, {fold} as fold from rows_), {newton_sql('folded', FEATURES, 'y', '1e0', 'fold', 'r.fold <> o.fold')}
    select r.fold, count(*) as n, round(avg(case when ({z} > 0) = (r.y = 1) then 1e0 else 0e0 end), 6) as accuracy from folded r join w{STEPS}_ w on w.fold = r.fold group by r.fold"""


PAIR_FEATURES = {"size": ["dw", "dc"], "words": ["dw"], "chars": ["dc"], "marks": ["dm"], "size and marks": ["dw", "dc", "dm"], "density": ["dr"], "all": ["dw", "dc", "dm", "dr"]}


def text_pairs(d: Dialect) -> str:
    """Each text with one drawn from its language, labelled by which has the higher source number: differences of what both look like."""
    w, m = d.count_matches("text", chr(92) + "S+"), d.count_matches("text", "[.,]")
    return f"""t as (select doc_id, lang, cast(substr(source, 4) as int) as grade, ln({w} + 1e0) as w, ln(length(text) + 1e0) as c, ln({m} + 1e0) as m from {{documents}} where text is not null),
    {numbered(d, "t", "lang", "doc_id", "ranked")},
    wishes as (select a.*, cast(1 + floor({d.uniform("'partner'", "a.doc_id")} * z.size) as bigint) as wish from t a join ranked_s z on z.lang = a.lang),
    pairs as (select case when b.grade > a.grade then 1e0 else 0e0 end as y, b.w - a.w as dw, b.c - a.c as dc, b.m - a.m as dm, (b.c - b.w) - (a.c - a.w) as dr
        from wishes a join ranked b on b.lang = a.lang and b.nth = a.wish where b.grade <> a.grade)"""


def ranked(spark: SparkSession, sf_dir: str, sets: dict[str, list[str]]) -> DataFrame:
    pairs = SqlQuery(lambda d: f"with {text_pairs(d)} select * from pairs")(spark, sf_dir).persist()  # read in every step of every fit
    out = []
    for name, features in sets.items():
        weights, scales = learn.pair_ranker(pairs, features, "y")
        z = sum((F.lit(float(w / s)) * F.col(c) for w, s, c in zip(weights, scales, features, strict=True)), F.lit(0.0))
        right = float(pairs.agg(F.avg(F.when((z > 0) == (F.col("y") == 1), 1.0).otherwise(0.0))).first()[0])
        out += [(name, c, round(float(w), 5), round(float(s), 6), round(right, 6)) for c, w, s in zip(features, weights, scales, strict=True)]
    pairs.unpersist()
    return spark.createDataFrame(out, "features string, term string, weight double, scale double, accuracy double")


def ranker_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranker without intercept, fitted on several sets of features: weights, scales and accuracy."""
    return ranked(spark, sf_dir, PAIR_FEATURES)


def ranker_sql(d: Dialect, name: str, features: list[str], tag: str) -> tuple[str, str]:
    scaled = ", ".join(f"r.{c} / s_{c} as {c}" for c in features)
    scales = ", ".join(f"stddev_pop({c}) + 1e-9 as s_{c}" for c in features)
    steps = newton_sql(f"scaled{tag}", features, "y", "1e0", intercept=False)
    for k in range(STEPS + 1):
        steps = steps.replace(f"w{k}_ ", f"w{k}_{tag} ").replace(f"p{k}_ ", f"p{k}_{tag} ").replace(f"g{k}_ ", f"g{k}_{tag} ").replace(f"s{k}__", f"s{k}_{tag}_").replace(f"s{k}_ ", f"s{k}_{tag} ")
        steps = steps.replace(f"from g{k}_)", f"from g{k}_{tag})").replace(f"from s{k}_)", f"from s{k}_{tag})")
    z = " + ".join(f"v{i} * r.{c}" for i, c in enumerate(features))
    body = f"scales{tag} as (select {scales} from pairs), scaled{tag} as (select y, {scaled} from pairs r cross join scales{tag}), {steps}, hits{tag} as (select avg(case when ({z} > 0) = (r.y = 1) then 1e0 else 0e0 end) as right_ from scaled{tag} r cross join w{STEPS}_{tag})"
    ends = [f"select '{name}' as features, '{c}' as term, round(v{i}, 5) as weight, round(s_{c}, 6) as scale, round(right_, 6) as accuracy from w{STEPS}_{tag} cross join scales{tag} cross join hits{tag}" for i, c in enumerate(features)]
    return body, " union all ".join(ends)


def ranker_sets_sql(d: Dialect) -> str:
    bodies, ends = zip(*(ranker_sql(d, name, features, f"t{k}") for k, (name, features) in enumerate(PAIR_FEATURES.items())), strict=True)
    return f"with {text_pairs(d)}, {', '.join(bodies)} {' union all '.join(ends)}"


def pair_ranker_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, {"all": PAIR_FEATURES["all"]}).drop("features")


def pair_ranker_fit_sql(d: Dialect) -> str:
    body, ends = ranker_sql(d, "all", PAIR_FEATURES["all"], "t")
    return f"with {text_pairs(d)}, {body} select term, weight, scale, accuracy from ({ends}) q"


def svm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = learn.squared_hinge(example(spark, sf_dir), FEATURES, "y", 0.001)
    return spark.createDataFrame([(t, round(float(w), 6)) for t, w in zip(["intercept", *FEATURES], weights, strict=True)], "term string, weight double")


def svm_fit_sql(d: Dialect) -> str:
    """The same Newton steps, written out; at rest the rows inside the margin stay the same."""
    x = ["1e0", *FEATURES]
    n, out = len(x), [f"w0_ as (select {', '.join(f'0e0 as w{i}' for i in range(len(x)))})"]
    for step in range(1, STEPS + 1):
        z = " + ".join(f"w{i} * {c}" for i, c in enumerate(x))
        inside = f"case when (2 * y - 1) * ({z}) < 1 then 1e0 else 0e0 end"
        sums = [f"sum(i_ * (2 * y - 1) * {c}) as g{i}" for i, c in enumerate(x)] + [f"sum(i_ * {x[j]} * {x[i]}) as h_{j}_{i}" for i in range(n) for j in range(i + 1)]
        out.append(f"g{step}_ as (select {', '.join(sums)} from (select r.*, {inside} as i_ from rows_ r cross join w{step - 1}_) q)")
        out.append(solved(f"w{step}_", f"g{step}_", "1 as one", n, lambda i, j: f"2 * 0.001e0 * h_{min(i, j)}_{max(i, j)}" + (" + 1" if i == j else ""), lambda i: f"2 * 0.001e0 * g{i}").replace(f"w{step}_ as (select 1 as one, ", f"w{step}_ as (select "))
    ends = " union all ".join(f"select '{t}' as term, round(w{i}, 6) as weight from w{STEPS}_" for i, t in enumerate(["intercept", *FEATURES]))
    return f"with {ROWS}, {', '.join(out)} {ends}"


def varying_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that vary at all, of some that don't."""
    rows = example(spark, sf_dir).withColumn("constant", F.lit(3.0)).withColumn("missing", F.lit(None).cast("double"))
    return spark.createDataFrame([(c,) for c in learn.varying(rows, [*FEATURES, "constant", "missing", "x0"])], "feature string")


def varying_features_sql(d: Dialect) -> str:
    names = {c: c for c in [*FEATURES, "x0"]} | {"constant": "3e0", "missing": "cast(null as double)"}
    return f"with {ROWS} " + " union all ".join(f"select '{n}' as feature from rows_ having coalesce(stddev_pop({c}), 0) > 0" for n, c in names.items())


def padded_pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading-time vectors of pairs of readers, in both orders: each reader draws a partner from all readers after the random stream."""
    m = reading_measures(tables.fixations(spark, sf_dir))
    times = m.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("wnum", "ffd"))), lambda s: s["ffd"]).alias("a"), F.sum("td").alias("total"))
    pairs = SqlQuery(reader_pairs)(spark, sf_dir)
    left = times.select(F.col("user_id").alias("r1"), "a", "total")
    right = times.select(F.col("user_id").alias("r2"), F.col("a").alias("b"), F.col("total").alias("other"))
    both = pairs.join(left, "r1").join(right, "r2").withColumn("harder", (F.col("total") > F.col("other")).cast("int"))
    vectors = learn.vectors_of_pairs(both, "a", "b", "harder", sums=("total", "other"))
    v = F.col("vector")
    return vectors.select(
        "label", F.size(v).alias("width"), F.round(F.aggregate(F.slice(v, 1, 60), F.lit(0.0), lambda x, y: x + y), 4).alias("left_sum"),
        F.round(F.aggregate(F.slice(v, 61, 60), F.lit(0.0), lambda x, y: x + y), 4).alias("right_sum"), F.round(v[0], 4).alias("left_first"), F.round(v[60], 4).alias("right_first"),
        v[120].alias("left_words"), F.round(v[122], 6).alias("left_mean"), v[121].alias("right_words"), F.round(v[123], 6).alias("right_mean"),
        F.round(v[124], 4).alias("left_total"), F.round(v[125], 4).alias("right_total"))


def reader_pairs(d: Dialect) -> str:
    return f"""with readers as (select distinct user_id, 1 as one from {{fix}}), {numbered(d, "readers", "one", "user_id", "ranked")},
    wishes as (select a.user_id as r1, cast(1 + floor({d.uniform("'partner'", "a.user_id")} * z.size) as bigint) as wish from readers a cross join ranked_s z)
    select r1, b.user_id as r2 from wishes join ranked b on b.nth = wish where b.user_id <> r1"""


def padded_pair_vectors_sql(d: Dialect) -> str:
    pairs = reader_pairs(d).strip()[len("with "):]
    cut = pairs.rindex("select r1, b.user_id")
    return f"""with {MEASURES}, {pairs[:cut].rstrip().rstrip(",")}, drawn as ({pairs[cut:]}),
    t as (select user_id, count(*) as n, sum(ffd) as s, sum(td) as total, arg_min(ffd, w) as f from m group by user_id),
    v as (select case when a.total > b.total then 1 else 0 end as label, a.n as an, a.s as as_, a.f as af, b.n as bn, b.s as bs, b.f as bf, a.total as at_, b.total as bt from drawn join t a on a.user_id = r1 join t b on b.user_id = r2),
    e as (select * from v union all select 1 - label as label, bn as an, bs as as_, bf as af, an as bn, as_ as bs, af as bf, bt as at_, at_ as bt from v)
    select label, 126 as width, round(as_, 4) as left_sum, round(bs, 4) as right_sum, round(af, 4) as left_first, round(bf, 4) as right_first, cast(an as double) as left_words, round(as_ / an, 6) as left_mean,
    cast(bn as double) as right_words, round(bs / bn, 6) as right_mean, round(at_, 4) as left_total, round(bt, 4) as right_total from e"""


QUERIES: dict = {}
FRAMES = {f.__name__: (f, SqlQuery(sql)) for f, sql in (
    (ridge_fit, ridge_fit_sql), (ridge_choice, ridge_choice_sql), (ridge_group_cv, ridge_group_cv_sql), (group_shuffle_cv, group_shuffle_cv_sql), (ablation, ablation_sql),
    (polynomial_cv, polynomial_cv_sql), (logistic_fit, logistic_fit_sql), (logistic_cv, logistic_cv_sql), (ranker_sets, ranker_sets_sql), (pair_ranker_fit, pair_ranker_fit_sql),
    (svm_fit, svm_fit_sql), (varying_features, varying_features_sql), (padded_pair_vectors, padded_pair_vectors_sql))}
