"""Queries that sample, split, pair, compare and resample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenread.functions.dialect import Dialect
from lumenread.operators import agreement
from lumenread.operators.rankdraws import spearman_draws
from lumenread.operators.resample import resampled
from lumenread.plans.query import FrameQuery, SqlQuery

#: Average ranks, as Spearman's coefficient takes them.
RANK = "rank() over (partition by {g} order by {x}) + (count(*) over (partition by {g}, {x}) - 1) / 2e0"
#: Draws of a resampled interval.
DRAWS = 2000
#: Rows of a bucket that rows are numbered in, so that no numbering is one task's.
BUCKET = 4096


def numbered(d: Dialect, rows: str, by: str, keys: str, out: str) -> str:
    """Relations that number rows from 1 within by: places in a hash bucket plus the rows of the buckets before."""
    return f"""{out}_b as (select r.*, cast(floor({d.uniform("'bucket'", *keys.split(", "))} * greatest(1, ceil(n.n / {BUCKET}e0))) as bigint) as bucket from {rows} r cross join (select count(*) as n from {rows}) n),
{out}_c as (select {by}, bucket, count(*) as n from {out}_b group by {by}, bucket),
{out}_o as (select {by}, bucket, coalesce(sum(n) over (partition by {by} order by bucket rows between unbounded preceding and 1 preceding), 0) as before from {out}_c),
{out}_s as (select {by}, sum(n) as size from {out}_c group by {by}),
{out} as (select b.*, cast(o.before + row_number() over (partition by b.{by}, b.bucket order by {", ".join("b." + k for k in keys.split(", "))}) as bigint) as nth from {out}_b b join {out}_o o on o.{by} = b.{by} and o.bucket = b.bucket)"""


def graded_sentences(d: Dialect) -> str:
    """All sentences, graded by their document's length."""
    if d.spark:  # sentences are measured before they meet their documents, so that their text isn't dealt out
        return """graded as (select s.doc_id, s.sid, cast(floor(ln(d.n_chars + 1e0)) as int) as grade, s.words, s.chars
    from (select doc_id, sid, length(sentence) - length(replace(sentence, ' ', '')) + 1 as words, length(sentence) as chars from {sent}) s join {documents} d on d.doc_id = s.doc_id)"""
    return """graded as (select s.doc_id, s.sid, cast(floor(ln(d.n_chars + 1e0)) as int) as grade, length(s.sentence) - length(replace(s.sentence, ' ', '')) + 1 as words, length(s.sentence) as chars
    from {sent} s join {documents} d on d.doc_id = s.doc_id)"""


#: Shares of a hundred that are the test's, and grades that a pair is apart at least.
TEST_SHARE, LEAST_GAP = 20, 2


def split_sentences(d: Dialect) -> str:
    """Graded sentences with the split of their document: the crc32 of grade and document, mod 100, below the test's share."""
    if d.spark:
        return f"""{graded_sentences(d)}, sided as (select *, case when crc32(concat_ws('-', cast(grade as string), cast(doc_id as string))) % 100 < {TEST_SHARE} then 'test' else 'train' end as split from graded)"""
    table = "list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
    return f"""{graded_sentences(d)}, tab as (select {table} as t), named as (select distinct doc_id, grade, concat(grade, '-', doc_id) as s from graded),
    sums as (select doc_id, grade, xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from named cross join tab),
    sided as (select g.*, case when x.crc % 100 < {TEST_SHARE} then 'test' else 'train' end as split from graded g join sums x on x.doc_id = g.doc_id and x.grade = g.grade)"""


def drawn_pairs(d: Dialect, draws: int = 1, least_gap: int = LEAST_GAP) -> str:
    """Pairs of an easier and a harder sentence at least least_gap grades apart and of one split: documents are split
    first, then every sentence draws from all sentences of each harder grade in its own split, with replacement;
    pairs that were drawn twice are one."""
    known = "/*+ broadcast(z) */" if d.spark else ""  # a row a side; dealt out by split, all sentences would go to two tasks
    return f"""{split_sentences(d)}, keyed as (select *, concat(split, grade) as side from sided), {numbered(d, "keyed", "side", "doc_id, sid", "ranked")},
    sides as (select distinct side, split, grade from keyed), sizes as (select s.split, s.grade, s.side, z.size from sides s join ranked_s z on z.side = s.side),
    wishes as (select {known} a.doc_id, a.sid, a.grade, a.split, a.words, a.chars, z.side as other, cast(1 + floor({d.uniform("'pair'", "a.doc_id", "a.sid", "z.grade", "t.draw")} * z.size) as bigint) as wish
        from sided a join sizes z on z.split = a.split and z.grade >= a.grade + {least_gap} cross join {d.series("1", str(draws), "draw")} t),
    pairs as (select distinct w.doc_id as doc_a, w.sid as sid_a, b.doc_id as doc_b, b.sid as sid_b, w.grade as grade_a, b.grade as grade_b, w.words as words_a, b.words as words_b, w.chars as chars_a, b.chars as chars_b, w.split as split
        from wishes w join ranked b on b.side = w.other and b.nth = w.wish)"""


def hash_split(d: Dialect) -> str:
    return f"""select doc_id, case when {d.uniform("'split'", 'doc_id')} < 0.6 then 'train' when {d.uniform("'split'", 'doc_id')} < 0.8 then 'dev' else 'test' end as split from {{documents}}"""


def group_split(d: Dialect) -> str:
    """A fifth of the sources, and all documents of them, for the test."""
    return f"select source, case when {d.uniform("'group'", 'source')} < 0.2 then 'test' else 'train' end as split, count(*) as docs from {{documents}} group by source"


def in_order(rows: str, by: str, bucket: str, order: str, out: str) -> str:
    """Relations that number rows from 1 in an order, within by: places in buckets that follow the order plus the rows of the buckets before."""
    return f"""{out}_b as (select r.*, cast({bucket} as bigint) as bucket from {rows} r), {out}_c as (select {by}, bucket, count(*) as n from {out}_b group by {by}, bucket),
    {out}_o as (select {by}, bucket, coalesce(sum(n) over (partition by {by} order by bucket rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over (partition by {by}) as size from {out}_c),
    {out} as (select b.*, cast(o.before + row_number() over (partition by b.{by}, b.bucket order by {order}) as bigint) as nth, o.size from {out}_b b join {out}_o o on o.{by} = b.{by} and o.bucket = b.bucket)"""


def seeded_group_split(d: Dialect) -> str:
    u = d.uniform("'42'", "user_id")
    return f"""with g as (select user_id, 1 as one, {u} as u from {{events}} group by user_id), {in_order("g", "one", "floor(u * 1024)", "u, user_id", "r")}
    select user_id, case when nth <= floor(size * 0.6) then 'train' when nth <= floor(size * 0.8) then 'dev' else 'test' end as split from r"""


def hash_sample(d: Dialect) -> str:
    return f"""with r as (select lang, doc_id, row_number() over (partition by lang order by {d.uniform("'7'", 'doc_id')}, doc_id) as rn from {{documents}})
    select lang, doc_id, rn from r where rn <= 25"""


def latin_square(d: Dialect) -> str:
    return f"""with i as (select item_id, 1 as one from {{benchmark}}), {in_order("i", "one", "floor(item_id / 4096e0)", "item_id", "x")} select item_id, list, (nth + list) % 4 as condition from x cross join {d.series("0", "3", "list")}"""


def batches(d: Dialect) -> str:
    return f"""with i as (select doc_id, lang from {{documents}}), {in_order("i", "lang", "floor(doc_id / 4096e0)", "doc_id", "x")} select doc_id, cast(floor((nth - 1) / 16e0) as bigint) as batch, lang from x"""


def graded_pairs(d: Dialect, least_gap: int = LEAST_GAP) -> str:
    """Pairs of sentences of one split, some grades apart; flipped by chance, with which side is harder and whether their words are about as many."""
    flip = f"{d.uniform(chr(39) + 'flip' + chr(39), 'doc_a', 'sid_a', 'doc_b', 'sid_b')} < 0.5"
    side = lambda a, b: f"case when flip then {b} else {a} end"
    return f"""with {drawn_pairs(d, least_gap=least_gap)}, f as (select *, {flip} as flip from pairs)
    select {side('doc_a', 'doc_b')} as doc_a, {side('sid_a', 'sid_b')} as sid_a, {side('doc_b', 'doc_a')} as doc_b, {side('sid_b', 'sid_a')} as sid_b, {side('grade_a', 'grade_b')} as grade_a, {side('grade_b', 'grade_a')} as grade_b,
    case when flip then 'a' else 'b' end as harder, grade_b - grade_a as gap, case when abs(words_a - words_b) <= 1 then 1 else 0 end as length_matched, split from f"""


def pair_baseline_accuracy(d: Dialect) -> str:
    """Direction from the training pairs, ties half right, on the test pairs."""
    return f"""with {drawn_pairs(d)}, k as (select sign(chars_b - chars_a) as delta, split from pairs),
    w as (select case when avg(delta) >= 0 then 1 else -1 end as direction from k where split = 'train')
    select count(*) as n, round(avg(case when delta = 0 then 0.5e0 when delta * direction > 0 then 1e0 else 0e0 end), 6) as accuracy, max(direction) as direction from k cross join w where split = 'test'"""


def counted_pairs(d: Dialect) -> str:
    """All pairs of sentences of equal words and different grades, from counts by grade, words and characters."""
    return f"""{graded_sentences(d)}, h as (select grade, words, chars, count(*) as n from graded group by grade, words, chars),
    p as (select a.grade as low, b.grade as high, a.chars as chars_a, b.chars as chars_b, cast(a.n * b.n as bigint) as n from h a join h b on b.words = a.words and b.grade > a.grade)"""


def length_matched(d: Dialect) -> str:
    return f"""with {counted_pairs(d)} select low, high, cast(sum(n) as bigint) as pairs, round(sum(n * abs(chars_a - chars_b)) / cast(sum(n) as double), 6) as mean_gap from p group by low, high"""


def gap_accuracy(d: Dialect) -> str:
    return f"""with {counted_pairs(d)}
    select high - low as gap, cast(sum(n) as bigint) as n, round(sum(n * case when chars_b > chars_a then 1e0 when chars_b = chars_a then 0.5e0 else 0e0 end) / sum(n), 6) as accuracy from p group by high - low"""


def pearson(d: Dialect) -> str:
    return """select event_type, count(*) as n, case when count(*) < 3 or stddev_pop(d) = 0 or stddev_pop(w) = 0 then null else round(corr(d, w), 6) end as r from {fix} group by event_type"""


def spearman(d: Dialect) -> str:
    rx, ry = RANK.format(g="user_id", x="d"), RANK.format(g="user_id", x="w")
    return f"""with r as (select user_id, {rx} as rx, {ry} as ry from {{fix}})
    select user_id, count(*) as n, case when count(*) < 3 or stddev_pop(rx) = 0 or stddev_pop(ry) = 0 then null else round(corr(rx, ry), 6) end as rho from r group by user_id"""


def partial_spearman(d: Dialect) -> str:
    """Spearman of the residuals of ranks after a linear fit to a third variable's ranks."""
    rx, ry, rz = (RANK.format(g="user_id", x=x) for x in ("d", "w", "i"))
    res = "r{0} - (m{0} + b{0} * (rz - mz))"
    return f"""with r as (select user_id, {rx} as rx, {ry} as ry, {rz} as rz from {{fix}}),
    m as (select user_id, avg(rx) as mx, avg(ry) as my, avg(rz) as mz, regr_slope(rx, rz) as bx, regr_slope(ry, rz) as by_ from r group by user_id having count(*) >= 5),
    e as (select r.user_id, round(rx - (mx + bx * (rz - mz)), 9) as ex, round(ry - (my + by_ * (rz - mz)), 9) as ey from r join m on m.user_id = r.user_id),
    k as (select user_id, {RANK.format(g='user_id', x='ex')} as kx, {RANK.format(g='user_id', x='ey')} as ky from e)
    select user_id, count(*) as n, round(corr(kx, ky), 6) as rho from k group by user_id"""


def r2_identity(d: Dialect) -> str:
    return """with f as (select label, regr_slope(y, x) as b, regr_intercept(y, x) as a, avg(y) as m, corr(y, x) as r from (
        select p.label, p.x as x, q.x as y from {dims} p join {dims} q on q.vec_id = p.vec_id and p.k = 0 and q.k = 1) z group by label),
    t as (select p.label, p.x as x, q.x as y from {dims} p join {dims} q on q.vec_id = p.vec_id and p.k = 0 and q.k = 1)
    select t.label, count(*) as n, round(1 - sum((y - a - b * x) * (y - a - b * x)) / sum((y - m) * (y - m)), 6) as r2, round(max(r) * max(r), 6) as r_squared from t join f on f.label = t.label group by t.label"""


def pairwise_agreement(d: Dialect) -> str:
    """Spearman's coefficient of every two readers over the words both read, then its mean by the first reader."""
    rank = "rank() over (partition by r1, r2 order by {0}) + (count(*) over (partition by r1, r2, {0}) - 1) / 2e0"
    pairs = "select a.user_id as r1, b.user_id as r2, a.td as x, b.td as y from m a join m b on b.w = a.w and a.user_id < b.user_id"
    return f"""with m as (select user_id, w, sum(d) as td from {{fix}} group by user_id, w), q as ({pairs}),
    k as (select r1, r2, {rank.format("x")} as rx, {rank.format("y")} as ry from q),
    p as (select r1, r2, count(*) as n, case when stddev_pop(rx) = 0 or stddev_pop(ry) = 0 then null else corr(rx, ry) end as r from k group by r1, r2 having count(*) >= 3)
    select r1 as user_id, count(*) as pairs, round(avg(r), 6) as mean_r, round(avg(n), 6) as mean_overlap from p group by r1"""


def leave_one_out(d: Dialect) -> str:
    return """with m as (select user_id, w, sum(d) as x from {fix} group by user_id, w),
    o as (select user_id, w, x, (sum(x) over (partition by w) - x) / nullif(count(*) over (partition by w) - 1, 0) as others from m)
    select user_id, count(*) as n, round(corr(x, others), 6) as r from o where others is not null group by user_id having count(*) >= 3"""


def percentile_ci(d: Dialect) -> str:
    if d.spark:
        return f"""with {quantiles("{fix}", "d", ["0.025e0", "0.5e0", "0.975e0", "0.75e0", "0.25e0"], "q", "event_type")}
    select event_type, cast(n as bigint) as n, round(q0, 6) as low, round(q1, 6) as median, round(q2, 6) as high, round(q3 - q4, 6) as iqr from q"""
    return f"""select event_type, count(*) as n, round({d.pct('d', 0.025)}, 6) as low, round({d.pct('d', 0.5)}, 6) as median, round({d.pct('d', 0.975)}, 6) as high,
    round({d.pct('d', 0.75)} - {d.pct('d', 0.25)}, 6) as iqr from {{fix}} group by event_type"""


def quantiles(relation: str, column: str, shares: list[str], out: str, by: str | None = None) -> str:
    """Relations that give exact quantiles of a column as q0, q1.., by a column if asked for, and n.

    A histogram of whole numbers finds the buckets that the ranks fall into; only rows of these are ordered.
    """
    value = lambda p, up: f"max(case when nth = floor({p} * (total - 1)){up} then x end)"
    part = lambda p: f"({p} * (max(total) - 1) - floor({p} * (max(total) - 1)))"
    picks = ", ".join(f"{value(p, '')} + {part(p)} * coalesce({value(p, ' + 1')} - {value(p, '')}, 0) as q{k}" for k, p in enumerate(shares))
    near = " or ".join(f"(floor({p} * (total - 1)) + 1 >= before and floor({p} * (total - 1)) < before + n)" for p in shares)
    own, listed, same, parted = (f"r.{by}, ", f"{by}, ", f" and k.{by} = r.{by}", f"partition by {by} ") if by else ("", "", "", "")
    return f"""{out}_h as (select {listed}floor({column}) as bucket, count(*) as n from {relation} where {column} is not null group by {listed}floor({column})),
    {out}_c as (select {listed}bucket, n, coalesce(sum(n) over ({parted}order by bucket rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over ({parted.strip()}) as total from {out}_h), {out}_k as (select * from {out}_c where {near}),
    {out}_r as (select {own}r.{column} as x, k.total, k.before + row_number() over (partition by {own.replace("r.", "k.")}k.bucket order by r.{column}) - 1 as nth from {relation} r join {out}_k k on floor(r.{column}) = k.bucket{same}), {out} as (select {listed}max(total) as n, {picks} from {out}_r {f"group by {by}" if by else ""})"""


def tertile_bands(d: Dialect) -> str:
    return f"""with {quantiles("{fix}", "d", ["(1 / 3e0)", "(2 / 3e0)"], "e")}, b as (select d, case when d <= q0 then 'low' when d <= q1 then 'mid' else 'high' end as band from {{fix}} cross join e)
    select band, count(*) as n, round(avg(d), 6) as mean_d from b group by band""" if d.spark else """with e as (select quantile_cont(d, 1/3e0) as a, quantile_cont(d, 2/3e0) as b from {fix})
    select case when d <= a then 'low' when d <= b then 'mid' else 'high' end as band, count(*) as n, round(avg(d), 6) as mean_d from {fix} cross join e
    group by case when d <= a then 'low' when d <= b then 'mid' else 'high' end"""


def drawn(u: str) -> str:
    """How often a unit is in a resample: Poisson with mean 1, from a number of the documented random stream.

    Every unit draws its own count, so no unit has to be numbered and no draw has to be gathered; draws
    are made and summed up in the same stage, so nothing but sums by draw is shuffled.
    """
    return f"(case when {u} < 0.36787944 then 0 when {u} < 0.73575888 then 1 when {u} < 0.91969860 then 2 when {u} < 0.98101184 then 3 when {u} < 0.99634015 then 4 else 5 end)"


def draws_of(d: Dialect, rows: str, columns: str, *streams: tuple[str, ...], draws: int = DRAWS) -> str:
    """rows once a draw, with how often each is drawn: the product of its streams' counts."""
    streams_ = ", ".join(f"{d.uniform(*s)} as u{k}" for k, s in enumerate(streams))
    times = " * ".join(drawn(f"u{k}") for k in range(len(streams)))
    return f"select draw, {columns}, {times} as times from (select draw, {columns}, {streams_} from {rows} cross join {d.series('1', str(draws), 'draw')} t) z"


def bootstrap_mean(d: Dialect, draws: int = DRAWS) -> str:
    """Interval of the mean label by language over resampled documents."""
    return f"""with x as (select l.doc_id, l.quality, o.lang from {{labels}} l join {{documents}} o on o.doc_id = l.doc_id),
    s as ({draws_of(d, "x", "lang, quality", ("'b'", "draw", "doc_id"), draws=draws)}),
    m as (select lang, draw, sum(quality * times) / cast(nullif(sum(times), 0) as double) as mean_q from s group by lang, draw)
    select lang, count(mean_q) as draws, round({d.pct('mean_q', 0.025)}, 6) as low, round({d.pct('mean_q', 0.5)}, 6) as median, round({d.pct('mean_q', 0.975)}, 6) as high from m group by lang"""


def bootstrap_spearman(d: Dialect, draws: int = 200) -> str:
    """Interval of Spearman's coefficient over resampled documents: ranks are taken anew in every draw, a unit counting as often as it is drawn."""
    rank = "sum(times) over (partition by draw order by {0}) - (sum(times) over (partition by draw, {0}) - 1) / 2e0"
    return f"""with x as (select l.doc_id, o.n_chars as x, length(replace(o.text, ' ', '')) / cast(o.n_chars as double) as y from {{labels}} l join {{documents}} o on o.doc_id = l.doc_id where o.n_chars > 0),
    s as (select * from ({draws_of(d, "x", "x, y", ("'rho'", "draw", "doc_id"), draws=draws)}) q where times > 0),
    r as (select draw, times, {rank.format("x")} as rx, {rank.format("y")} as ry from s),
    m as (select draw, (sum(times * rx * ry) - sum(times * rx) * sum(times * ry) / sum(times)) / nullif(sqrt((sum(times * rx * rx) - sum(times * rx) * sum(times * rx) / sum(times)) * (sum(times * ry * ry) - sum(times * ry) * sum(times * ry) / sum(times))), 0) as rho from r group by draw)
    select count(rho) as draws, round({d.pct('rho', 0.025)}, 6) as low, round({d.pct('rho', 0.5)}, 6) as median, round({d.pct('rho', 0.975)}, 6) as high from m"""


def cluster_bootstrap_diff(d: Dialect, draws: int = DRAWS) -> str:
    """Readers are drawn, and with them all their fixations: interval and one-sided share of a difference."""
    return f"""with c as (select user_id, sum(case when w < 4 then d else 0 end) as sa, sum(case when w < 4 then 1 else 0 end) as na, sum(case when w >= 4 then d else 0 end) as sb, sum(case when w >= 4 then 1 else 0 end) as nb from {{fix}} group by user_id),
    s as ({draws_of(d, "c", "sa, na, sb, nb", ("'c'", "draw", "user_id"), draws=draws)}),
    m as (select draw, sum(sa * times) / nullif(sum(na * times), 0) - sum(sb * times) / nullif(sum(nb * times), 0) as diff from s group by draw)
    select count(diff) as draws, round({d.pct('diff', 0.025)}, 6) as low, round({d.pct('diff', 0.975)}, 6) as high, round(avg(case when diff <= 0 then 1e0 else 0e0 end), 6) as p from m"""


def pair_bootstrap(d: Dialect, draws: int = DRAWS) -> str:
    """Texts are drawn; a pair weighs the product of its texts' counts."""
    return f"""with w as (select user_id, w, avg(d) as x from {{fix}} group by user_id, w),
    p as (select a.user_id, a.w as wa, b.w as wb, case when b.x > a.x then 1e0 when b.x = a.x then 0.5e0 else 0e0 end as hit from w a join w b on b.w = a.w + 1 and a.user_id = b.user_id),
    s as ({draws_of(d, "p", "hit", ("'p'", "draw", "user_id", "wa"), ("'p'", "draw", "user_id", "wb"), draws=draws)}),
    m as (select draw, sum(hit * times) / cast(nullif(sum(times), 0) as double) as acc from s group by draw)
    select count(acc) as draws, round({d.pct('acc', 0.025)}, 6) as low, round({d.pct('acc', 0.975)}, 6) as high from m"""


def interval(statistic: Column, *shares: float) -> list[Column]:
    return [F.round(F.percentile(statistic, q), 6) for q in shares]


def ratio(value: str, times: str = "times") -> Column:
    """A sum over another; null where nothing was drawn."""
    return F.col(value) / F.when(F.col(times) != 0, F.col(times))


def mean_interval(frames: dict, draws: int = DRAWS) -> DataFrame:
    units = frames["labels"].select("doc_id", "quality").join(frames["documents"].select("doc_id", "lang"), "doc_id")
    means = resampled(units, [("b", ["doc_id"])], ["quality"], ["lang"], draws).select("lang", ratio("quality").alias("m"))
    low, median, high = interval(F.col("m"), 0.025, 0.5, 0.975)
    return means.groupBy("lang").agg(F.count("m").alias("draws"), low.alias("low"), median.alias("median"), high.alias("high"))


def spearman_interval(frames: dict, draws: int = 200) -> DataFrame:
    """Documents without text have no y and come last, as the oracle orders nulls."""
    y = F.coalesce(F.length(F.replace("text", F.lit(" "), F.lit(""))) / F.col("n_chars").cast("double"), F.lit(float("inf")))
    units = frames["documents"].filter(F.col("n_chars") > 0).select("doc_id", F.col("n_chars").cast("double").alias("x"), y.alias("y"))
    units = units.join(frames["labels"].select("doc_id"), "doc_id").select(F.col("doc_id").cast("string").alias("key"), "x", "y")
    low, median, high = interval(F.col("rho"), 0.025, 0.5, 0.975)
    return spearman_draws(units, "rho", draws).agg(F.count("rho").alias("draws"), low.alias("low"), median.alias("median"), high.alias("high"))


def difference_interval(frames: dict, draws: int = DRAWS) -> DataFrame:
    low = F.col("w") < 4
    pick = lambda on, x: F.sum(F.when(on, x).otherwise(0.0))
    readers = frames["fix"].groupBy("user_id").agg(pick(low, F.col("d")).alias("sa"), pick(low, F.lit(1.0)).alias("na"), pick(~low, F.col("d")).alias("sb"), pick(~low, F.lit(1.0)).alias("nb"))
    found = resampled(readers, [("c", ["user_id"])], ["sa", "na", "sb", "nb"], draws=draws).select((ratio("sa", "na") - ratio("sb", "nb")).alias("m"))
    first, last = interval(F.col("m"), 0.025, 0.975)
    return found.agg(F.count("m").alias("draws"), first.alias("low"), last.alias("high"), F.round(F.avg(F.when(F.col("m") <= 0, 1.0).when(F.col("m") > 0, 0.0)), 6).alias("p"))


def pair_interval(frames: dict, draws: int = DRAWS) -> DataFrame:
    means = frames["fix"].groupBy("user_id", "w").agg(F.avg("d").alias("x"))
    after = means.select("user_id", (F.col("w") - 1).alias("w"), F.col("x").alias("y"))
    hit = F.when(F.col("y") > F.col("x"), 1.0).when(F.col("y") == F.col("x"), 0.5).otherwise(0.0)
    pairs = means.join(after, ["user_id", "w"]).select("user_id", F.col("w").alias("wa"), (F.col("w") + 1).alias("wb"), hit.alias("hit"))
    pairs = pairs.repartition("user_id").sortWithinPartitions("user_id", "wa")  # a word is in two pairs; its draws are remembered from one to the next
    found = resampled(pairs, [("p", ["user_id", "wa"]), ("p", ["user_id", "wb"])], ["hit"], draws=draws).select(ratio("hit").alias("m"))
    low, high = interval(F.col("m"), 0.025, 0.975)
    return found.agg(F.count("m").alias("draws"), low.alias("low"), high.alias("high"))


def threshold_fits(prediction: str, step: int, steps: int) -> str:
    """fits (th, r2) of all thresholds from 0, step apart: rows are summed up by the first threshold above their prediction,
    and running sums over these few rows give what is lost by skipping (below) and by predicting (from there on)."""
    return f"""x as (select d as y, {prediction} as p from {{fix}}), h as (select cast(least({steps} + 1, greatest(0, floor(p / {step}e0) + 1)) as int) as k, sum(y * y) as skipped, sum((y - p) * (y - p)) as told, count(*) as n, sum(y) as sy from x group by k),
    g as (select k, coalesce(skipped, 0) as skipped, coalesce(told, 0) as told, n, sy from (select explode(sequence(0, {steps} + 1)) as k) s left join h using (k)),
    r as (select k, sum(skipped) over (order by k) as below, sum(told) over (order by k desc) - told as above, sum(skipped) over () - sum(sy) over () * sum(sy) over () / sum(n) over () as spread from g),
    fits as (select {step} * k as th, 1 - (below + above) / spread as r2 from r where k <= {steps})"""


def threshold_search(d: Dialect) -> str:
    """Predictions below a threshold count as skips; the threshold with the best fit, if better than none."""
    if d.spark:
        return f"with {threshold_fits('20e0 * w', 1, 150)}, placed as (select *, row_number() over (order by round(r2, 9) desc, th) as rn from fits) select cast(th as bigint) as th, round(r2, 6) as r2 from placed where rn = 1"
    return f"""with x as (select d as y, 20e0 * w as p from {{fix}}), m as (select avg(y) as m from x),
    t as (select th, 1 - sum((y - case when p < th then 0 else p end) * (y - case when p < th then 0 else p end)) / sum((y - m) * (y - m)) as r2 from x cross join m cross join {d.series('0', '150', 'th')} group by th),
    r as (select *, row_number() over (order by round(r2, 9) desc, th) as rn from t)
    select th, round(r2, 6) as r2 from r where rn = 1"""


def pair_vectors(d: Dialect) -> str:
    """Both orders of a pair of documents two grades apart, labelled by which side is first; every easier document draws two partners."""
    return f"""with {graded_sentences(d)}, texts as (select doc_id, grade, count(*) as n, sum(words) as words, sum(chars) as chars from graded group by doc_id, grade),
    {numbered(d, "texts", "grade", "doc_id", "ranked")},
    wishes as (select a.doc_id, a.words, a.chars, z.grade as other, cast(1 + floor({d.uniform("'vector'", "a.doc_id", "t.draw")} * z.size) as bigint) as wish from texts a join ranked_s z on z.grade = a.grade + 2 cross join {d.series("1", "2", "draw")} t),
    p as (select distinct b.doc_id as a, w.doc_id as b, b.words - w.words as dw, b.chars - w.chars as dc from wishes w join ranked b on b.grade = w.other and b.nth = w.wish)
    select a, b, dw, dc, 1 as label from p union all select b as a, a as b, -dw as dw, -dc as dc, 0 as label from p"""


def pair_score(d: Dialect) -> str:
    """A fixed linear score of both sides and the verdict."""
    return f"""with {drawn_pairs(d)}, p as (select *, 0.3e0 * (words_b - words_a) + 0.02e0 * (chars_b - chars_a) as delta from pairs)
    select doc_a, sid_a, doc_b, sid_b, round(1 / (1 + exp(-delta)), 6) as p_harder, case when delta > 0 then 1 else 0 end as agree from p"""


def feature_stability(d: Dialect) -> str:
    """Each feature's spread within targets and between their means, population spreads both."""
    if d.spark:
        return """with g as (select k, label, avg(x) as m, var_pop(x) as v from {dims} group by k, label)
    select k, round(sqrt(avg(v)), 6) as within_sd, round(stddev_pop(m), 6) as between_sd, round(stddev_pop(m) / nullif(sqrt(avg(v)), 0), 6) as ratio from g group by k"""
    return """with c as (select *, x - avg(x) over (partition by k, label) as off_ from {dims}), g as (select k, label, avg(x) as m, avg(off_ * off_) as v from c group by k, label), o as (select *, m - avg(m) over (partition by k) as dm from g)
    select k, round(sqrt(sum(v) / count(*)), 6) as within_sd, round(sqrt(sum(dm * dm) / count(*)), 6) as between_sd, round(sqrt(sum(dm * dm) / nullif(sum(v), 0)), 6) as ratio from o group by k"""


def per_target_error(d: Dialect) -> str:
    """Predictions of each target against it: errors by axis and as lengths, the mean prediction's bias, spreads around it."""
    points = "select a.label, a.x as px, b.x as py, 0.1e0 as tx, -0.1e0 as ty from {dims} a join {dims} b on a.vec_id = b.vec_id and a.k = 0 and b.k = 1"
    if d.spark:
        return f"""with e as (select *, sqrt((px - tx) * (px - tx) + (py - ty) * (py - ty)) as err from ({points}) p)
    select label, count(*) as samples, round(avg(px), 6) as mean_pred_x, round(avg(py), 6) as mean_pred_y, round(avg(abs(px - tx)), 6) as mae_x, round(avg(abs(py - ty)), 6) as mae_y, round(avg(err), 6) as mean_error, round({d.pct('err', 0.5)}, 6) as median_error,
    round(sqrt(power(avg(px) - max(tx), 2) + power(avg(py) - max(ty), 2)), 6) as bias, round(stddev_pop(px), 6) as sd_x, round(stddev_pop(py), 6) as sd_y, case when label between 1 and 3 then 'inner' else 'edge' end as place from e group by label"""
    return f"""with p as ({points}), s as (select label, list(px) as xs, list(py) as ys, list(sqrt(pow(px - tx, 2) + pow(py - ty, 2))) as es, max(tx) as tx, max(ty) as ty from p group by label),
    m as (select *, list_avg(xs) as mx, list_avg(ys) as my from s)
    select label, len(xs) as samples, round(mx, 6) as mean_pred_x, round(my, 6) as mean_pred_y, round(list_avg(list_transform(xs, lambda v: abs(v - tx))), 6) as mae_x, round(list_avg(list_transform(ys, lambda v: abs(v - ty))), 6) as mae_y, round(list_avg(es), 6) as mean_error, round(list_median(es), 6) as median_error,
    round(sqrt(pow(mx - tx, 2) + pow(my - ty, 2)), 6) as bias, round(sqrt(list_avg(list_transform(xs, lambda v: pow(v - mx, 2)))), 6) as sd_x, round(sqrt(list_avg(list_transform(ys, lambda v: pow(v - my, 2)))), 6) as sd_y, case when label in (1, 2, 3) then 'inner' else 'edge' end as place from m"""


def validation_summary(d: Dialect) -> str:
    return f"""with p as (select label, k, {d.pct('x', 0.5)} as mx from {{dims}} where k < 2 group by label, k),
    e as (select label, sqrt(sum(mx * mx)) as err from p group by label) select count(*) as points, round({d.pct('err', 0.5)}, 6) as median_err, round(max(err), 6) as worst from e"""


def standardise(d: Dialect) -> str:
    return "with s as (select k, avg(x) as m, stddev_pop(x) as s from {dims} group by k) select d.vec_id, d.k, round((d.x - s.m) / nullif(s.s, 0), 5) as z from {dims} d join s on s.k = d.k"


def ols_single(d: Dialect) -> str:
    return """select l_returnflag, count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2
    from {lineitem} group by l_returnflag"""


def mean_imputation(d: Dialect) -> str:
    return """with x as (select s_suppkey, case when s_suppkey % 7 = 0 then null else s_acctbal end as x from {supplier}), m as (select avg(x) as m from x)
    select s_suppkey, round(coalesce(x, m), 4) as balance from x cross join m"""


def linear_scorer(d: Dialect) -> str:
    """Null features count as 0; predictions below the threshold are skips."""
    return """with s as (select vec_id, sum(case k when 0 then 2e0 when 1 then -1e0 when 2 then 0.5e0 else 0e0 end * coalesce(x, 0)) + 0.25e0 as p from {dims} group by vec_id)
    select vec_id, round(case when p < 0.1 then 0 else p end, 6) as prediction from s"""


def reader_qc(d: Dialect) -> str:
    return """with a as (select user_id, avg(case when event_type <> 'error' then 1e0 else 0e0 end) as accuracy from {fix} group by user_id), k as (select user_id from a where accuracy >= 0.7)
    select f.user_id, count(*) as n, round(sum(d), 3) as total_d from {fix} f join k on k.user_id = f.user_id group by f.user_id"""


def calibration_selection(d: Dialect) -> str:
    return f"""with x as (select vec_id, label, x as openness, row_number() over (partition by label order by vec_id) as n from {{dims}} where k = 0),
    m as (select label, {d.pct('abs(openness)', 0.5)} as med from x group by label)
    select x.label, count(*) as kept, sum(case when abs(openness) < 0.6 * med then 1 else 0 end) as blinks from x join m on m.label = x.label where n > 3 group by x.label"""


def two_level_mean(d: Dialect) -> str:
    return """with s as (select user_id, event_type, sum(d) as total from {fix} group by user_id, event_type) select event_type, count(*) as readers, round(avg(total), 4) as mean_total from s group by event_type"""


def mode_vote(d: Dialect) -> str:
    """The most frequent answer; of several the one that came first."""
    return """with c as (select user_id, event_type, count(*) as n, min(i) as first_i from {fix} group by user_id, event_type), r as (select *, row_number() over (partition by user_id order by n desc, first_i) as rn from c)
    select user_id, event_type as vote, n from r where rn = 1"""


def survey_unpivot(d: Dialect) -> str:
    wide = "select doc_id, quality as q1, toxic as q2, quality + toxic as q3 from {labels}"
    if d.spark:
        return f"select doc_id, question, answer from ({wide}) unpivot (answer for question in (q1, q2, q3))"
    return f"with wide as ({wide}) select doc_id, question, answer from (unpivot wide on q1, q2, q3 into name question value answer)"


def side_mapping(d: Dialect) -> str:
    """Answers about sides A and B, mapped to original and simplified by the key."""
    return f"""with a as (select doc_id, quality, toxic, case when {d.uniform("'side'", 'doc_id')} < 0.5 then 'original' else 'simplified' end as a_is, case when quality = 1 then 'A' when toxic = 1 then 'B' else 'Same' end as easier from {{labels}})
    select case when easier = 'Same' then 'same' when (easier = 'A') = (a_is = 'original') then 'original' else 'simplified' end as verdict, a_is, count(*) as n from a
    group by case when easier = 'Same' then 'same' when (easier = 'A') = (a_is = 'original') then 'original' else 'simplified' end, a_is"""


def item_means(d: Dialect) -> str:
    return """select d.lang, count(*) as n, round(avg(l.quality), 6) as quality, round(avg(case when l.toxic = 1 then l.quality end), 6) as quality_toxic, count(distinct d.source) as sources
    from {labels} l join {documents} d on d.doc_id = l.doc_id group by d.lang"""


def answer_clamp(d: Dialect) -> str:
    return "select doc_id, greatest(1, least(5, cast(floor(n_chars / 500e0) as int))) as answer from {documents}"


def override_join(d: Dialect) -> str:
    return """select o.doc_id, coalesce(l.quality, cast(o.n_chars % 2 as int)) as value, case when l.doc_id is null then 'default' else 'override' end as origin from {documents} o left join {labels} l on l.doc_id = o.doc_id"""


def default_lookup(d: Dialect) -> str:
    return """with n as (select word, count(*) as c from {tok} group by word) select l.word, coalesce(n.c, 0) as n, coalesce(length(n.word), -1) as len from {lex} l left join n on n.word = l.word"""


def semi_split(d: Dialect) -> str:
    return """select lang, count(*) as n from {documents} d where exists (select 1 from {labels} l where l.doc_id = d.doc_id and l.quality = 1) group by lang"""


def anti_seen(d: Dialect) -> str:
    return "select d.doc_id, d.lang from {documents} d where not exists (select 1 from {labels} l where l.doc_id = d.doc_id)"


def first_wins(d: Dialect) -> str:
    """One row a key, the first by order."""
    return "with r as (select source, lang, doc_id, row_number() over (partition by source, lang order by doc_id) as rn from {documents}) select source, lang, doc_id from r where rn = 1"


def last_wins(d: Dialect) -> str:
    return "with r as (select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc) as rn from {lineitem}) select l_partkey, l_orderkey, l_linenumber from r where rn = 1"


def nearest_level(d: Dialect) -> str:
    return """with levels as (select label as level, avg(x) as m from {dims} where k = 0 group by label), s as (select vec_id, x from {dims} where k = 0),
    r as (select s.vec_id, l.level, row_number() over (partition by s.vec_id order by round(abs(s.x - l.m), 9), l.level) as rn from s cross join levels l) select vec_id, level from r where rn = 1"""


def level_profile(d: Dialect) -> str:
    return "select label as level, k, count(*) as n, round(avg(x), 6) as mean_x from {dims} group by label, k"


def confusion_by_label(d: Dialect) -> str:
    return "select quality, toxic, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from {labels} group by quality, toxic"


def ablation_groups(d: Dialect) -> str:
    """Fit of one feature after the other, by the share of variance each explains alone."""
    return """with y as (select vec_id, x as y from {dims} where k = 0) select d.k, round(coalesce(regr_r2(y.y, d.x), 0), 6) as r2 from {dims} d join y on y.vec_id = d.vec_id where d.k > 0 group by d.k"""


def tumbling(d: Dialect) -> str:
    return """select cast(floor(t / 86400) as bigint) as day, event_type, count(*) as n, round(sum(d), 3) as total from {fix} group by cast(floor(t / 86400) as bigint), event_type"""


def sessions(d: Dialect) -> str:
    """Runs of events of a user without a gap of more than two days."""
    return """with b as (select *, case when t - lag(t) over (partition by user_id order by i) <= 172800 then 0 else 1 end as brk from {fix}),
    s as (select *, sum(brk) over (partition by user_id order by i rows unbounded preceding) as session from b)
    select user_id, cast(session as bigint) as session, count(*) as n, round(max(t) - min(t), 3) as seconds from s group by user_id, session"""


HEADS = """
words as (select item_id, word, row_number() over (partition by item_id order by nth) as id from ({items}) q),
heads as (select a.item_id, a.id, a.word, coalesce(min(b.id), 0) as head from words a left join words b on b.item_id = a.item_id and b.id > a.id and length(b.word) > length(a.word) group by a.item_id, a.id, a.word)
"""


def heads(d: Dialect) -> str:
    """A dependency tree an item: a word's head is the next longer one, else the root."""
    if d.spark:
        items = r"select item_id, posexplode(regexp_extract_all(lower(text), r'\p{L}+', 0)) as (nth, word) from {benchmark}"
    else:
        items = r"select item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as word, unnest(range(len(regexp_extract_all(lower(text), '\p{L}+')))) as nth from {benchmark}"
    return HEADS.replace("{items}", items)


def score_change(d: Dialect) -> str:
    return """with s as (select a.vec_id, a.x as before_x, b.x as after_x from {dims} a join {dims} b on a.vec_id = b.vec_id and a.k = 0 and b.k = 1)
    select count(*) as n, round(avg(after_x - before_x), 6) as mean_change, round(avg(case when after_x < before_x then 1e0 else 0e0 end), 6) as easier, sum(case when after_x = before_x then 1 else 0 end) as unchanged from s"""


QUERIES = {f.__name__: SqlQuery(f) for f in (
    hash_split, group_split, seeded_group_split, hash_sample, latin_square, batches, graded_pairs, pair_baseline_accuracy, length_matched,
    gap_accuracy, pearson, spearman, partial_spearman, r2_identity, leave_one_out, percentile_ci, tertile_bands,
    threshold_search, pair_vectors, pair_score, feature_stability, per_target_error, validation_summary, standardise,
    ols_single, mean_imputation, linear_scorer, reader_qc, calibration_selection, two_level_mean, mode_vote, survey_unpivot, side_mapping, item_means,
    answer_clamp, override_join, default_lookup, semi_split, anti_seen, first_wins, last_wins, nearest_level, level_profile, confusion_by_label,
    ablation_groups, tumbling, sessions, score_change)}
QUERIES |= {
    "bootstrap_spearman": FrameQuery(bootstrap_spearman, spearman_interval, ("labels", "documents")),
    "bootstrap_mean": FrameQuery(bootstrap_mean, mean_interval, ("labels", "documents")), "cluster_bootstrap_diff": FrameQuery(cluster_bootstrap_diff, difference_interval, ("fix",)),
    "pair_bootstrap": FrameQuery(pair_bootstrap, pair_interval, ("fix",)), "pairwise_agreement": FrameQuery(pairwise_agreement, agreement.mean_agreement, ("fix",))}
FRAMES: dict = {}
