"""Queries over fixation logs: reading measures, runs, gaps, windows and joins in order."""

from __future__ import annotations

from lumenread.functions.dialect import Dialect
from lumenread.operators import gaze
from lumenread.plans.query import SqlQuery

MEASURES = """
b as (select *, case when lag(w) over (partition by user_id order by i) = w then 0 else 1 end as brk from {fix}),
r as (select *, sum(brk) over (partition by user_id order by i rows unbounded preceding) as run from b),
f as (select user_id, w, min(i) as first_i, min(run) as first_run from r group by user_id, w),
g as (select f.user_id, f.w, x.next_forward as fwd from f join {nxt} x on x.user_id = f.user_id and x.i = f.first_i),
m as (select f.user_id, f.w,
    sum(case when r.i = f.first_i then r.d else 0 end) as ffd,
    sum(case when r.run = f.first_run then r.d else 0 end) as fpd,
    sum(case when g.fwd is null or r.i < g.fwd then r.d else 0 end) as rpd,
    sum(r.d) as td, count(*) as n_fix
    from f join r on r.user_id = f.user_id and r.w = f.w left join g on g.user_id = f.user_id and g.w = f.w group by f.user_id, f.w)
"""


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 4) as {n}" for n in names)


def measures_oracle(d: Dialect) -> str:
    return f"with {MEASURES} select user_id, w as wnum, {rounded('ffd', 'fpd', 'rpd', 'td')}, n_fix from m"


def measures_avg_all(d: Dialect) -> str:
    return f"""with {MEASURES}, n as (select count(distinct user_id) as readers from {{fix}})
    select w as wnum, round(sum(ffd) / max(readers), 4) as ffd, round(sum(fpd) / max(readers), 4) as fpd,
    round(sum(rpd) / max(readers), 4) as rpd, round(sum(td) / max(readers), 4) as td from m cross join n group by w"""


def measures_avg_good(d: Dialect) -> str:
    return f"""with {MEASURES}, good as (select user_id from {{fix}} group by user_id having count(*) >= 20),
    n as (select count(*) as readers from good)
    select w as wnum, round(avg(td), 4) as td, round(avg(ffd), 4) as ffd, count(*) as n_readers,
    round(1 - count(*) / cast(max(readers) as double), 6) as skip_rate from m join good using (user_id) cross join n group by w"""


def skip_rate(d: Dialect) -> str:
    return f"""with seen as (select distinct user_id, w from {{fix}}), n as (select count(distinct user_id) as readers from {{fix}}),
    words as {d.series('0', '7', 'w')}
    select words.w as wnum, round(1 - count(seen.user_id) / cast(max(readers) as double), 6) as skip_rate
    from words cross join n left join seen on seen.w = words.w group by words.w"""


def first_pass_runs(d: Dialect) -> str:
    return """with b as (select *, case when lag(w) over (partition by user_id order by i) = w then 0 else 1 end as brk from {fix}),
    r as (select *, sum(brk) over (partition by user_id order by i rows unbounded preceding) as run from b)
    select user_id, cast(run as bigint) as run, min(w) as wnum, min(i) as first_i, max(i) as last_i, count(*) as n, round(sum(d), 4) as duration from r group by user_id, run"""


def regression_forward(d: Dialect) -> str:
    return "select user_id, i, w as wnum, next_forward from {nxt}"


def lag_lead_context(d: Dialect) -> str:
    return """select user_id, i, w as wnum, coalesce(lag(w) over (partition by user_id order by i), -1) as prev_w,
    coalesce(lead(w) over (partition by user_id order by i), -1) as next_w,
    rank() over (partition by user_id, w order by i) as nth_visit, count(*) over (partition by user_id, w) as visits from {fix}"""


def running_median3(d: Dialect) -> str:
    return """with x as (select user_id, i, d, lag(d, 1, d) over (partition by user_id order by i) as p, lead(d, 1, d) over (partition by user_id order by i) as n,
    count(*) over (partition by user_id) as c from {fix})
    select user_id, i, round(case when c < 3 then d else greatest(least(d, p), least(greatest(d, p), n)) end, 6) as smooth from x"""


def blink_gaps(d: Dialect) -> str:
    return """with v as (select user_id, i, t, case when event_type = 'error' or w = 0 then 0 else 1 end as valid from {fix}),
    b as (select *, sum(valid) over (partition by user_id order by i rows unbounded preceding) as island, lead(t) over (partition by user_id order by i) as next_t,
    max(t) over (partition by user_id) as end_t from v)
    select user_id, cast(island as bigint) as island, min(i) as first_i, count(*) as n, round(max(coalesce(next_t, end_t)) - min(t), 6) as seconds
    from b where valid = 0 group by user_id, island having max(coalesce(next_t, end_t)) - min(t) >= 60"""


def visits(d: Dialect) -> str:
    return """with h as (select user_id, i, t, d, case when w < 6 then w else -1 end as hit from {fix}),
    b as (select *, case when lag(hit) over (partition by user_id order by i) = hit then 0 else 1 end as brk from h),
    r as (select *, sum(brk) over (partition by user_id order by i rows unbounded preceding) as run from b)
    select user_id, row_number() over (partition by user_id order by min(i)) as visit, min(hit) as box, round(min(t), 3) as start_t, round(sum(d), 4) as duration, count(*) as samples
    from r where hit >= 0 group by user_id, run"""


def launch_distance(d: Dialect) -> str:
    return """with x as (select user_id, i, event_type, w * 10 as xpos, cast(floor((i - 1) / 10.0) as bigint) as line from {fix}),
    p as (select *, lag(xpos) over (partition by user_id order by i) as px, lag(line) over (partition by user_id order by i) as pl, lag(event_type) over (partition by user_id order by i) as pe from x)
    select user_id, i, line, case when px is null then 0 when pl <> line or pe = 'error' then -99 else px - xpos end as launch from p"""


def interval_join(d: Dialect) -> str:
    """Samples of each interval from one event on word 0 to the next: a sample's is the last that began by its time."""
    return """with s as (select user_id, i as sid, lead(t) over (partition by user_id order by i) as off_t from {fix} where w = 0),
    x as (select user_id, d, max(case when w = 0 then i end) over (partition by user_id order by t range between unbounded preceding and current row) as sid from {fix})
    select x.user_id, x.sid, count(*) as samples, round(sum(x.d), 4) as duration from x join s on s.user_id = x.user_id and s.sid = x.sid where s.off_t is not null group by x.user_id, x.sid"""


def sentence_windows(d: Dialect) -> str:
    return """with e as (select user_id, i, t, case when w = 0 then 'on' when w = 7 then 'off' end as kind from {fix}),
    o as (select *, max(case when kind = 'on' then t end) over (partition by user_id order by i rows between unbounded preceding and 1 preceding) as on_t from e),
    p as (select *, row_number() over (partition by user_id order by i desc) as rn from o where kind = 'off' and on_t is not null)
    select user_id, i as off_i, round(on_t, 3) as on_t, round(t, 3) as off_t from p where rn = 1"""


def layout_positions(d: Dialect) -> str:
    return """select doc_id, sid, length(sentence) as chars, row_number() over (partition by doc_id order by sid) as serial,
    cast(coalesce(sum(length(sentence) + 1) over (partition by doc_id order by sid rows between unbounded preceding and 1 preceding), 0) as bigint) as start_col from {sent}"""


def sample_interval(d: Dialect) -> str:
    return f"""with x as (select user_id, t - lag(t) over (partition by user_id order by i) as gap from {{fix}})
    select user_id, count(gap) as n, round({d.pct('gap', 0.5)}, 6) as median_gap from x where gap is not null and gap <= 100000 group by user_id"""


def gaze_quality(d: Dialect) -> str:
    return """with q as (select user_id, floor((i - 1) / 20.0) as sid, avg(case when event_type = 'error' then 0e0 else 1e0 end) as valid,
    avg(case when w >= 6 then 1e0 else 0e0 end) as off_text, sum(case when w < 6 then 1 else 0 end) as on_word from {fix} group by user_id, floor((i - 1) / 20.0))
    select user_id, cast(sid as bigint) as sid, round(valid, 6) as valid, round(off_text, 6) as off_text,
    concat_ws('; ', case when valid < 0.7 then 'low valid share' end, case when off_text > 0.3 then 'off text' end, case when on_word = 0 then 'no word' end) as reasons from q"""


def fixation_noise(d: Dialect, longest: float = gaze.TOO_LONG) -> str:
    """Fixations that are too long or off the text, by share of the events and time that they take."""
    return f"""with x as (select d, case when d > {longest} then 'too_long' when w >= 6 then 'off_text' else 'ok' end as label from {{fix}}) select label, count(*) as n, round(sum(d), 3) as duration, round(max(d), 6) as longest from x group by label"""


#: Sentences of 20 events (q), their words' measures without noise (p), and each reader's limits (l).
OUTLIERS = f"""with e as (select *, (i - 1) // 20 as sid from {{fix}}), q as (select user_id, sid, avg((event_type <> 'error')::int) >= 0.7 and avg((w >= 6)::int) <= 0.5 and count(case when d <= 1200 and w < 6 then 1 end) > 0 as ok from e group by user_id, sid),
    s as (select user_id, sid, i, w, d from e where d <= 1200 and w < 6), n as (select a.user_id, a.sid, a.i, a.w, a.d, (select min(b.i) from s b where b.user_id = a.user_id and b.sid = a.sid and b.i > a.i and b.w > a.w) as fwd,
        (select max(b.i) from s b where b.user_id = a.user_id and b.sid = a.sid and b.i < a.i and b.w <> a.w) as broken from s a),
    f as (select *, min(i) over (partition by user_id, sid, w) as i1 from n), g as (select *, max(case when i = i1 then coalesce(broken, -1) end) over (partition by user_id, sid, w) as run, max(case when i = i1 then fwd end) over (partition by user_id, sid, w) as out_ from f),
    m as (select user_id, sid, w, sum(case when i = i1 then d else 0 end) as ffd, sum(case when coalesce(broken, -1) = run then d else 0 end) as fpd, sum(case when out_ is null or i < out_ then d else 0 end) as rpd, sum(d) as td from g group by user_id, sid, w),
    p as (select m.*, q.ok from m join q on q.user_id = m.user_id and q.sid = m.sid), l as (select user_id, {", ".join(f"avg({m}) + 3 * stddev_pop({m}) as l{m}" for m in gaze.MEASURES)} from p where ok group by user_id)"""


def outlier_tests() -> list[str]:
    return [f"{m} > l{m}" for m in gaze.MEASURES]


def outlier_oracle(d: Dialect) -> str:
    """Words of readers' sentences, measured without noise, beside their reader's limits."""
    named = ", ".join(f"case when ok and {t} then '{m.upper()}' end" for m, t in zip(gaze.MEASURES, outlier_tests(), strict=True))
    return f"{OUTLIERS} select p.user_id, p.sid, p.w as wnum, ok::int as sentence_ok, concat_ws(', ', {named}) as outlier, case when ok and not ({' or '.join(outlier_tests())}) then 1 else 0 end as keep from p left join l on l.user_id = p.user_id"


def zscore_reader(d: Dialect) -> str:
    return """select user_id, i, round((d - avg(d) over (partition by user_id)) / nullif(stddev_samp(d) over (partition by user_id), 0), 6) as z from {fix}"""


def trim_3sd(d: Dialect) -> str:
    """Logs beyond three deviations of their reader's; the log of 0 is the oracle's, minus infinity, which leaves its reader no limits."""
    return f"""with l as (select user_id, i, {d.ln('d')} as y from {{fix}}), z as (select *, avg(y) over (partition by user_id) as m, stddev_samp(y) over (partition by user_id) as s from l)
    select user_id, count(*) as n, sum(case when abs(y - m) > 3 * s then 1 else 0 end) as trimmed, round(avg(case when abs(y - m) <= 3 * s then y end), 6) as mean_log from z group by user_id"""


def skipped_words(d: Dialect) -> str:
    return f"""with readers as (select distinct user_id from {{fix}}), words as {d.series('0', '7', 'w')},
    seen as (select user_id, w, count(*) as n, sum(d) as d from {{fix}} group by user_id, w)
    select r.user_id, words.w as wnum, coalesce(s.n, 0) as n, round(coalesce(s.d, -99), 4) as duration from readers r cross join words left join seen s on s.user_id = r.user_id and s.w = words.w"""


def landing_position(d: Dialect) -> str:
    return """with x as (select user_id, i, w + 3 as olen, d / 100e0 as share from {fix})
    select user_id, i, case when share < 0 then 0 else least(olen, cast(floor(share * olen) as int) + 1) end as oblp,
    greatest(0, least(olen - 1, cast(floor(share * olen) as int))) as wdlp from x"""


def depth_flags(d: Dialect) -> str:
    return """with x as (select user_id, i, w as depth, lag(w) over (partition by user_id order by i) as p from {fix})
    select user_id, i, coalesce(depth - p, 0) as depth_diff,
    case when p is not null and depth <> p then 1 else 0 end as h1, case when p is not null and depth > p then 1 else 0 end as h2,
    case when p is not null and depth < p then 1 else 0 end as h3, case when p is not null and depth = 0 then 1 else 0 end as h4, 0 as h5,
    case when p is not null and depth - p >= 2 then 1 else 0 end as h6, case when p is not null and p - depth >= 2 then 1 else 0 end as h7,
    case when p is not null and depth = p then 1 else 0 end as h8 from x"""


def session_choice(d: Dialect) -> str:
    return """with s as (select user_id, event_type, max(t) as last_t, count(*) as n from {fix} group by user_id, event_type),
    r as (select *, row_number() over (partition by user_id order by n desc, last_t desc, event_type) as rn from s)
    select user_id, event_type, round(last_t, 3) as last_t, n from r where rn = 1"""


def idt_oracle(d: Dialect, spread: float = 80, gap: float = 3 * 86400, least: float = 60) -> str:
    """The growing window as a relation that steps sample by sample: a window of samples a to b is extended, or closed and the next one begun."""
    wider = "greatest(r.hx, n.x) - least(r.lx, n.x) + greatest(r.hy, n.y) - least(r.ly, n.y)"
    grows = f"(n.i is not null and n.t - r.tb <= {gap} and {wider} <= {spread})"
    done = f"(r.tb - r.ta + r.usual >= {least})"
    pick = lambda grown, begun: f"case when {grows} then {grown} else {begun} end"
    return f"""with recursive s as (select user_id, i, t, w * 10e0 as x, d as y from {{fix}}), gaps as (select user_id, t - lag(t) over (partition by user_id order by i) as g from s),
    u as (select user_id, quantile_cont(g, 0.5) as usual from gaps group by user_id having count(*) > 1),
    r as (select s.user_id, u.usual, s.i as a, s.i as b, s.x as lx, s.x as hx, s.y as ly, s.y as hy, s.t as ta, s.t as tb, cast(null as bigint) as fa, cast(null as bigint) as fb from s join u on u.user_id = s.user_id where s.i = 1
    union all select r.user_id, r.usual, {pick('r.a', 'p.i')}, {pick('n.i', 'p.i')}, {pick('least(r.lx, n.x)', 'p.x')}, {pick('greatest(r.hx, n.x)', 'p.x')}, {pick('least(r.ly, n.y)', 'p.y')}, {pick('greatest(r.hy, n.y)', 'p.y')},
        {pick('r.ta', 'p.t')}, {pick('n.t', 'p.t')}, case when not {grows} and {done} then r.a end, case when not {grows} and {done} then r.b end
        from r left join s n on n.user_id = r.user_id and n.i = r.b + 1 left join s p on p.user_id = r.user_id and p.i = case when {done} then r.b + 1 else r.a + 1 end where r.a is not null),
    f as (select user_id, fa, fb, row_number() over (partition by user_id order by fa) as fxno from r where fa is not null)
    select f.user_id, f.fxno, round(min(s.t), 3) as start_t, round(max(s.t) + max(u.usual), 3) as end_t, round(quantile_cont(s.x, 0.5), 6) as x, round(quantile_cont(s.y, 0.5), 6) as y, count(*) as samples from f join u on u.user_id = f.user_id join s on s.user_id = f.user_id and s.i between f.fa and f.fb group by f.user_id, f.fxno"""


QUERIES = {name: SqlQuery(f) for name, f in {
    "measures_avg_all": measures_avg_all, "measures_avg_good": measures_avg_good, "skip_rate": skip_rate, "first_pass_runs": first_pass_runs,
    "regression_forward": regression_forward, "lag_lead_context": lag_lead_context, "running_median3": running_median3, "blink_gaps": blink_gaps,
    "visits": visits, "launch_distance": launch_distance, "interval_join": interval_join,
    "sentence_windows": sentence_windows, "layout_positions": layout_positions, "sample_interval": sample_interval,
    "gaze_quality": gaze_quality, "fixation_noise": fixation_noise, "zscore_reader": zscore_reader, "trim_3sd": trim_3sd,
    "skipped_words": skipped_words, "landing_position": landing_position, "depth_flags": depth_flags, "session_choice": session_choice,
}.items()}

FRAMES = {"reading_measures": (gaze.reading_measures_query, SqlQuery(measures_oracle)), "idt_fixations": (gaze.idt_query, SqlQuery(idt_oracle)), "outlier_keep": (gaze.outlier_query, SqlQuery(outlier_oracle))}
