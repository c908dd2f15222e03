"""Queries over typed sentences, sub-words, tags, cards and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenread.functions.dialect import Dialect
from lumenread.functions.treebank import tokenised_sql
from lumenread.operators.resample import resampled
from lumenread.plans.query import FrameQuery, SqlQuery
from lumenread.plans.statistics import DRAWS, draws_of, heads, interval, ratio, threshold_fits

#: Endings that a word is cut at, the longest first, and the letters that its stem keeps at least: fixed values.
ENDINGS, STEM = ("tion", "ing", "ble", "ed", "er", "es", "ly", "s"), 3
#: Weights of an example score: fixed values.
WEIGHTS = {"n_words": 0.05, "mean_len": 0.4, "longest": 0.1, "types": -0.02, "commas": 0.15}


def typed(d: Dialect, table: str = "{benchmark}", key: str = "item_id") -> str:
    """Words between blanks of short texts, in order: key, id from 1, token, and the letters of it in lower case."""
    blank = chr(92) + "s+"
    if d.spark:
        rows = f"select {key}, posexplode(split(trim(text), r'{blank}')) as (nth, token) from {table}"
    else:
        rows = f"select {key}, unnest(range(len(regexp_split_to_array(trim(text), '{blank}')))) as nth, unnest(regexp_split_to_array(trim(text), '{blank}')) as token from {table}"
    return f"typed as (select {key}, cast(nth + 1 as int) as id, token, {d.replace('lower(token)', '[^' + chr(92) + 'p{L}]', '')} as word from ({rows}) q where token <> '')"


def word_rows(d: Dialect) -> str:
    """One row a reader and word, the earliest fixation's."""
    return "with r as (select user_id, w, i, d, row_number() over (partition by user_id, w order by i) as rn from {fix}) select user_id, w as wnum, i, d from r where rn = 1"


def session_relabel(d: Dialect) -> str:
    """Readers whose id changes from some time on, by a table of (old id, since, new id)."""
    table = "select 1 as old_id, 1704240000e0 as since, 100001 as new_id union all select 2 as old_id, 1704412800e0 as since, 100002 as new_id union all select 3 as old_id, 1e12 as since, 100003 as new_id"
    return f"""with c as ({table}) select coalesce(case when f.t >= c.since then c.new_id end, f.user_id) as reader, count(*) as n, round(min(f.t), 3) as since from {{fix}} f left join c on c.old_id = f.user_id
    group by coalesce(case when f.t >= c.since then c.new_id end, f.user_id)"""


def aligned_join(d: Dialect) -> str:
    """Orders with their customers under another key name, and whether every order found exactly one."""
    return """with j as (select o.o_orderkey, c.c_custkey, c.c_nationkey from {orders} o join {customer} c on o.o_custkey = c.c_custkey), n as (select count(*) as orders, count(distinct o_orderkey) as keys from {orders}),
    t as (select c_nationkey, count(*) as n from j group by c_nationkey), a as (select sum(n) as joined from t)
    select c_nationkey, t.n, case when joined = orders and keys = orders then 1 else 0 end as aligned from t cross join a cross join n"""


def sentence_means(d: Dialect) -> str:
    """Reading times of sentences over readers, and how many answered right."""
    return """with s as (select user_id, cast(floor((i - 1) / 10.0) as bigint) as sid, sum(d) as total, count(*) as n, min(case when event_type = 'error' then 0 else 1 end) as right_ from {fix} group by user_id, cast(floor((i - 1) / 10.0) as bigint))
    select sid, count(*) as readers, round(avg(total), 4) as mean_total, round(avg(n), 4) as mean_fixations, round(avg(right_), 6) as accuracy from s group by sid"""


def participant_summary(d: Dialect) -> str:
    return """with s as (select user_id, cast(floor((i - 1) / 10.0) as bigint) as sid, sum(d) as total, min(case when event_type = 'error' then 0 else 1 end) as right_, count(*) as n from {fix} group by user_id, cast(floor((i - 1) / 10.0) as bigint))
    select user_id, count(*) as sentences, cast(sum(n) as bigint) as fixations, round(sum(total), 4) as total, round(avg(total), 6) as mean_total, round(avg(right_), 6) as accuracy, case when avg(right_) >= 0.3 and sum(n) >= 20 then 1 else 0 end as kept from s group by user_id"""


def word_means(d: Dialect) -> str:
    """Word means over kept readers who fixated the word, with how many there were, how many were kept and the skip rate, to one decimal."""
    return """with r as (select user_id, case when count(*) >= 20 and avg(case when event_type = 'error' then 0e0 else 1e0 end) >= 0.6 then 1 else 0 end as kept from {fix} group by user_id),
    s as (select f.user_id, f.w, max(r.kept) as kept, sum(f.d) as td, min(f.d) as shortest from {fix} f join r on r.user_id = f.user_id group by f.user_id, f.w), n as (select sum(kept) as readers from r)
    select w as wnum, count(*) as n_fixated, cast(sum(s.kept) as bigint) as n_kept, round(1 - sum(s.kept) / cast(max(readers) as double), 6) as skip_rate, round(avg(case when s.kept = 1 then td end), 1) as td, round(avg(case when s.kept = 1 then shortest end), 1) as shortest from s cross join n group by w"""


def any_overlap(d: Dialect) -> str:
    """Items that hold any of some words."""
    words = "('the', 'idiot', 'with', 'nowhere')"
    if d.spark:
        return f"select item_id, case when arrays_overlap(split(lower(text), ' '), array{words}) then 1 else 0 end as found, size(array_intersect(split(lower(text), ' '), array{words})) as kinds from {{benchmark}}"
    listed = "['the', 'idiot', 'with', 'nowhere']"
    return f"select item_id, case when list_has_any(string_split(lower(text), ' '), {listed}) then 1 else 0 end as found, len(list_intersect(string_split(lower(text), ' '), {listed})) as kinds from {{benchmark}}"


def ptb_tokens(d: Dialect) -> str:
    """Sentences with brackets, quotes, marks and contractions as tokens of their own."""
    tricky = "case when sid % 5 = 1 then concat(replace(sentence, ' ', ' don''t (it''s) '), '.') when sid % 5 = 2 then concat('\"', sentence, '\" he''ll [cannot] say 1,000, more''n I wanna...') else sentence end"
    return f"with x as (select doc_id, sid, {tricky} as sentence from {{sent}}) select doc_id, sid, {tokenised_sql(d, 'sentence')} as tokens from x"


#: Marks before and after a word, and the code of the first closing one: fixed values.
OPENING, CLOSING, CODES = "\"'‘“([", ".,;:?!\"'’”)]", {".": 1, ",": 2, ";": 3, ":": 4, "?": 5, "!": 6}


def mark_codes(d: Dialect) -> str:
    """Each word without its marks, how many open and close it, the code of the first closing one, how often the bare word occurs and its column."""
    quote = lambda x: x.replace("'", "''")
    core = f"trim(leading '{quote(OPENING)}' from token)" if d.spark else f"ltrim(token, '{quote(OPENING)}')"
    bare = f"trim(trailing '{quote(CLOSING)}' from core)" if d.spark else f"rtrim(core, '{quote(CLOSING)}')"
    code = "case " + " ".join(f"when closing like '{k}%' then {v}" for k, v in CODES.items()) + " else 0 end"
    return f"""with {typed(d)}, c as (select item_id, id, token, {core} as core from typed), b as (select *, {bare} as bare from c), m as (select *, substr(core, length(bare) + 1) as closing from b)
    select item_id, id, bare, length(token) - length(core) as omarks, length(closing) as emarks, {code} as punct, count(*) over (partition by bare) as txfr, cast(coalesce(sum(length(token) + 1) over (partition by item_id order by id rows between unbounded preceding and 1 preceding), 0) as int) as initial from m"""


#: Parts of words that a broken one leaves behind, letters that begin no word, and what is left out besides: values of the query.
FRAGMENTS, NO_START, LEFT_OUT = ("tion", "ment", "ung", "ción", "ble"), "ßñç", ("idiot", "license")


def eligible(d: Dialect, low: int = 10, high: int = 30) -> str:
    """Sentences of the hardest level of their language with 10 to 30 words that end in their only stop, without digits, brackets or quotes,
    words left out, and broken words: a word after the first that begins as no word does, or is a known fragment. Of equal sentences the first stays."""
    s = chr(92)
    words = d.count_matches("whole", s + "S+")
    odd = "[0-9=(){}<>" + s + "[" + s + "]" + '"“”‘’]'
    level = "cast(floor(ln(o.n_chars + 1e0)) as int)"
    joined = f"select s.doc_id, s.sid, concat(s.sentence, '.') as whole, s.sentence, {level} as grade, max({level}) over (partition by o.lang) as hardest from {{sent}} s join {{documents}} o on o.doc_id = s.doc_id"
    if d.spark:  # a language is one task's in a window: its hardest level is aggregated and joined
        joined = f"""select s.doc_id, s.sid, concat(s.sentence, '.') as whole, s.sentence, o.grade, h.hardest from {{sent}} s join (select doc_id, lang, {level} as grade from {{documents}} o) o on o.doc_id = s.doc_id
            join (select o.lang, max({level}) as hardest from {{documents}} o left semi join (select distinct doc_id from {{sent}}) t on t.doc_id = o.doc_id group by o.lang) h on h.lang <=> o.lang and h.hardest = o.grade"""
    if d.spark:
        listed = ", ".join(f"'{f}'" for f in FRAGMENTS)
        rest = f"slice(regexp_extract_all(lower(sentence), r'{s}p{{L}}+', 0), 2, greatest(0, size(regexp_extract_all(lower(sentence), r'{s}p{{L}}+', 0)) - 1))"
        broken = f"exists({rest}, w -> w in ({listed}) or substr(w, 1, 1) in ({', '.join(repr(c) for c in NO_START)}))"
    else:
        rest = f"regexp_extract_all(lower(sentence), '{s}p{{L}}+')[2:]"
        broken = f"len(list_filter({rest}, lambda w: list_contains([{', '.join(repr(f) for f in FRAGMENTS)}], w) or contains('{NO_START}', substr(w, 1, 1)))) > 0"
    left_out = " or ".join(f"lower(sentence) like '%{x}%'" for x in LEFT_OUT)
    return f"""with x as ({joined}), y as (select * from x where grade = hardest and {words} between {low} and {high} and not {d.matches('sentence', '[.?!]')} and not {d.matches('sentence', odd)} and not ({left_out}) and not ({broken}))
    select min(doc_id) as doc_id, whole as sentence, count(*) as copies from y group by whole"""


def plain_sentences(d: Dialect) -> str:
    """Sentences without bullet, number, speaker and quotes, on one line."""
    s = chr(92)
    speaker = "case when sid % 7 = 1 then concat('Anna: ', sentence) when sid % 7 = 2 then concat('12) ', sentence) when sid % 7 = 3 then concat('- ', sentence) else sentence end"
    step = d.replace(speaker, s + "s+", " ")
    for pattern in ("^ *[-•*] +", "^ *[0-9]+[.)] *", "^ *" + s + "p{L}+: +", '[“”"«»]'):
        step = d.replace(step, pattern, "")
    return f"select doc_id, sid, trim({step}) as sentence from {{sent}}"


def visual_angle(d: Dialect) -> str:
    return "select user_id, i, round(degrees(atan2(d / 10e0, 60e0)), 6) as angle, round(degrees(atan2(2e0 * w, 60e0)), 6) as offset_angle from {fix}"


def date_stamps(d: Dialect) -> str:
    stamp = "date_format(ts, 'yyyyMMdd_HH')" if d.spark else "strftime(ts, '%Y%m%d_%H')"
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")" if d.spark else "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    return f"select {stamp} as stamp, count(*) as n, sum(case when {iso} >= '2024-01-03T12:00:00' then 1 else 0 end) as late, min({iso}) as first_at from {{events}} group by {stamp}"


def feature_pairs(d: Dialect) -> str:
    """Features written name=value with bars between, as a map; and whether a feature is in a set."""
    text = "concat('Flag=', l_returnflag, '|Status=', l_linestatus, '|Line=', cast(l_linenumber as {t}))"
    if d.spark:
        x = f"select str_to_map({text.format(t='string')}, '[|]', '=') as m from {{lineitem}}"
        return f"with x as ({x}) select m['Flag'] as flag, m['Line'] as line, count(*) as n, sum(case when array_contains(map_keys(m), 'Status') and m['Status'] in ('F', 'X') then 1 else 0 end) as marked from x group by m['Flag'], m['Line']"
    x = f"select map_from_entries(list_transform(string_split({text.format(t='varchar')}, '|'), lambda p: struct_pack(k := string_split(p, '=')[1], v := string_split(p, '=')[2]))) as m from lineitem"
    return f"with x as ({x}) select m['Flag'] as flag, m['Line'] as line, count(*) as n, cast(sum(case when m['Status'] in ('F', 'X') then 1 else 0 end) as bigint) as marked from x group by m['Flag'], m['Line']"


def typed_features(d: Dialect) -> str:
    """A typed sentence's features, its n-grams looked up in the counts of the documents, its words in their tree."""
    counts = """kw as (select distinct word from heads), uni as (select word, count(*) as c from {tok} group by word),
    bi as (select s.prev as w1, s.word as w2, count(*) as c from {seq} s join kw on kw.word = s.prev group by s.prev, s.word), v as (select count(*) as vocabulary, sum(c) as total from uni)"""  # only pairs that begin with a typed word
    return f"""with {heads(d)}, {counts}, lex_ as (select item_id, id, word, lag(word) over (partition by item_id order by id) as prev, lead(word) over (partition by item_id order by id) as next from heads),
    ent as (select b.w1, -sum(b.c / cast(u.c2 as double) * ln(b.c / cast(u.c2 as double))) as h from bi b join (select w1, sum(c) as c2 from bi group by w1) u on u.w1 = b.w1 group by b.w1),
    depth_ as (select h.item_id, h.id, count(g.id) as depth from heads h left join heads g on g.item_id = h.item_id and g.id > h.id and h.head > 0 and g.id <= h.head group by h.item_id, h.id),
    one as (select l.item_id, l.id, l.word, length(l.word) as len, coalesce(f.c, 0) as n, ln(coalesce(f.c, 0) / cast(v.total as double) + 1e-9) as log_freq,
        case when l.prev is null then ln(1e0 / v.vocabulary) else ln((coalesce(fw.c, 0) + 1e0) / (coalesce(p.c, 0) + v.vocabulary)) end as fwd, case when l.next is null then ln(1e0 / v.vocabulary) else ln((coalesce(bw.c, 0) + 1e0) / (coalesce(n.c, 0) + v.vocabulary)) end as bwd,
        case when l.prev is null then 0e0 else -ln((coalesce(fw.c, 0) + 1e0) / (coalesce(p.c, 0) + v.vocabulary)) end as surprisal, coalesce(e.h, ln(cast(v.vocabulary as double))) as entropy, h.head, d.depth
        from lex_ l cross join v join heads h on h.item_id = l.item_id and h.id = l.id join depth_ d on d.item_id = l.item_id and d.id = l.id left join uni f on f.word = l.word left join uni p on p.word = l.prev left join uni n on n.word = l.next
        left join bi fw on fw.w1 = l.prev and fw.w2 = l.word left join bi bw on bw.w1 = l.word and bw.w2 = l.next left join ent e on e.w1 = l.word),
    two as (select *, lag(entropy) over (partition by item_id order by id) as before, lag(depth) over (partition by item_id order by id) as up from one)
    select item_id, count(*) as n_words, round(avg(len), 6) as mean_len, max(len) as longest, round(avg(log_freq), 6) as log_freq, round(min(log_freq), 6) as rarest, sum(case when n = 0 then 1 else 0 end) as unknown, round(avg(fwd), 6) as fwd, round(avg(bwd), 6) as bwd,
    round(avg(surprisal), 6) as surprisal, round(max(surprisal), 6) as max_surprisal, round(sum(surprisal), 5) as sum_surprisal, round(avg(entropy), 6) as entropy, round(sum(coalesce(greatest(0e0, before - entropy), 0)), 5) as reduction, round(avg(case when head > 0 then head - id end), 6) as distance,
    max(depth) as span, sum(case when depth > up then 1 else 0 end) as rises, sum(case when depth < up then 1 else 0 end) as falls, count(distinct word) as types, round(count(distinct word) / cast(count(*) as double), 6) as ttr from two group by item_id"""


def simple_features(d: Dialect) -> str:
    """Features of a text that its words alone give."""
    return f"f as (select item_id, count(*) as n_words, round(avg(length(token)), 6) as mean_len, max(length(token)) as longest, count(distinct word) as types, sum(case when token like '%,' then 1 else 0 end) as commas from typed group by item_id)"


def explanation(d: Dialect) -> str:
    """Weight times value of each feature of a text, and their sum."""
    rows = " union all ".join(f"select item_id, '{k}' as feature, cast({k} as double) as value, {w}e0 as weight from f" for k, w in WEIGHTS.items())
    return f"with {typed(d)}, {simple_features(d)}, r as ({rows}) select item_id, feature, round(value, 6) as value, weight, round(value * weight, 6) as part, round(sum(value * weight) over (partition by item_id), 6) as score from r"


def profile_verdict(d: Dialect) -> str:
    """A text's features beside the typical values of the easiest and the hardest of four levels, and which is nearer."""
    rows = " union all ".join(f"select item_id, level, '{k}' as feature, cast({k} as double) as value from l" for k in WEIGHTS)
    return f"""with {typed(d)}, {simple_features(d)}, s as (select f.*, {' + '.join(f'{w}e0 * {k}' for k, w in WEIGHTS.items())} as score from f), l as (select s.*, cast(floor(item_id % 4) as int) + 1 as level from s), r as ({rows}),
    p as (select feature, avg(case when level = 1 then value end) as low, avg(case when level = 4 then value end) as high from r group by feature)
    select r.item_id, r.feature, round(r.value, 6) as value, round(p.low, 6) as low, round(p.high, 6) as high, case when abs(r.value - p.low) <= abs(r.value - p.high) then 'level 1' else 'level 4' end as nearer from r join p on p.feature = r.feature"""


def fixated_only(d: Dialect) -> str:
    """A fit on all words, skipped ones with 0, beside one on fixated words only."""
    return """with m as (select user_id, w, sum(d) as td from {fix} group by user_id, w), r as (select distinct user_id from {fix}), words as (select distinct w from {fix}),
    a as (select r.user_id, words.w, coalesce(m.td, 0) as td from r cross join words left join m on m.user_id = r.user_id and m.w = words.w)
    select 'all' as rows_, count(*) as n, round(regr_slope(td, w), 6) as slope, round(regr_r2(td, w), 6) as r2 from a union all select 'fixated' as rows_, count(*) as n, round(regr_slope(td, w), 6) as slope, round(regr_r2(td, w), 6) as r2 from a where td > 0"""


def threshold_grid(d: Dialect) -> str:
    """The threshold of 0, 5 to 150 with the best fit."""
    if d.spark:
        return f"with {threshold_fits('20e0 * w', 5, 30)} select cast(th as int) as th, round(r2, 6) as r2, row_number() over (order by round(r2, 9) desc, th) as place from fits"
    return f"""with x as (select d as y, 20e0 * w as p from {{fix}}), m as (select avg(y) as m from x),
    t as (select 5 * th as th, 1 - sum((y - case when p < 5 * th then 0 else p end) * (y - case when p < 5 * th then 0 else p end)) / sum((y - m) * (y - m)) as r2 from x cross join m cross join {d.series('0', '30', 'th')} g group by th)
    select cast(th as int) as th, round(r2, 6) as r2, row_number() over (order by round(r2, 9) desc, th) as place from t"""


def word_wrap(d: Dialect, width: int = 60) -> str:
    """Greedy lines of at most width characters: the first word that doesn't fit starts the next line."""
    if d.spark:
        blank = chr(92) + "s+"
        fits = f"a.stop + 1 + length(t) <= {width}"
        step = f"(a, t) -> named_struct('line', case when a.stop < 0 or {fits} then a.line else a.line + 1 end, 'stop', case when a.stop >= 0 and {fits} then a.stop + 1 + length(t) else length(t) end, 'out', concat(a.out, array(named_struct('line', case when a.stop < 0 or {fits} then a.line else a.line + 1 end, 'x', case when a.stop >= 0 and {fits} then a.stop + 1 else 0 end, 'n', length(t)))))"
        start = "named_struct('line', 1, 'stop', -1, 'out', cast(array() as array<struct<line:int,x:int,n:int>>))"
        return f"""with w as (select item_id, aggregate(filter(split(trim(text), r'{blank}'), t -> t <> ''), {start}, {step}).out as out from {{benchmark}}), p as (select item_id, posexplode(out) as (nth, o) from w)
    select item_id, cast(nth + 1 as int) as id, o.line as line, o.x as x, o.x + o.n as stop, round((2 * o.x + o.n) / 2e0, 1) as middle from p"""
    return f"""with recursive {typed(d)}, t as (select item_id, id, 1 as line, 0 as x, length(token) as stop from typed where id = 1
    union all select w.item_id, w.id, case when t.stop + 1 + length(w.token) <= {width} then t.line else t.line + 1 end as line, case when t.stop + 1 + length(w.token) <= {width} then t.stop + 1 else 0 end as x,
        case when t.stop + 1 + length(w.token) <= {width} then t.stop + 1 + length(w.token) else length(w.token) end as stop from typed w join t on w.item_id = t.item_id and w.id = t.id + 1)
    select item_id, id, line, x, stop, round((x + stop) / 2e0, 1) as middle from t"""


def scripted_reader(d: Dialect) -> str:
    """A reader after a script: short words may be skipped, long ones read twice, durations by length, all by the random stream."""
    u = lambda name: d.uniform(f"'{name}'", "item_id", "id")
    return f"""{typed(d)}, plan as (select item_id, id, length(word) as len, {u('skip')} as us, {u('again')} as ua, {u('time')} as ut from typed where word <> ''),
    looks as (select item_id, id, 1 as look, len, ut from plan where not (len <= 3 and us < 0.4) union all select item_id, id, 2 as look, len, ut from plan where len >= 7 and ua < 0.3),
    script as (select item_id, id as w, look, row_number() over (partition by item_id order by id, look) as i, round(120 + 18 * len + 40 * ut, 2) as d from looks)"""


def simulated_log(d: Dialect) -> str:
    return f"with {scripted_reader(d)} select item_id, i, w as wnum, look, d from script"


def truth_agreement(d: Dialect) -> str:
    """The script, kept as JSON, against what a detector with a floor and noise found of it: agreement, correlation, mean error."""
    if d.spark:
        kept, w, dur = "to_json(named_struct('w', w, 'd', d))", "cast(get_json_object(detail, '$.w') as int)", "cast(get_json_object(detail, '$.d') as double)"
    else:
        kept, w, dur = "to_json(struct_pack(w := w, d := d))", "cast(json_extract_string(detail, '$.w') as int)", "cast(json_extract_string(detail, '$.d') as double)"
    noise = d.uniform("'noise'", "item_id", "i")
    return f"""with {scripted_reader(d)}, truth as (select item_id, i, {kept} as detail, d, {noise} as u from script), t as (select item_id, i, {w} as w, {dur} as d, u from truth),
    f as (select item_id, i, case when u < 0.1 then w + 1 else w end as w, d + 30 * (u - 0.5) as d from t where d >= 160)
    select t.item_id, count(*) as scripted, count(f.i) as found, round(avg(case when f.w = t.w then 1e0 else 0e0 end), 6) as agreement, case when count(f.i) < 3 then null else round(corr(t.d, f.d), 6) end as r, round(avg(abs(t.d - f.d)), 6) as mae from t left join f on f.item_id = t.item_id and f.i = t.i group by t.item_id"""


def question_scoring(d: Dialect) -> str:
    return """select o.lang, count(*) as n, sum(case when l.quality = 1 - l.toxic then 1 else 0 end) as right_, round(avg(case when l.quality = 1 - l.toxic then 1e0 else 0e0 end), 6) as accuracy from {labels} l join {documents} o on o.doc_id = l.doc_id group by o.lang"""


def stems(d: Dialect) -> str:
    stem, ending = "core", "''"
    for e in reversed(ENDINGS):
        fits = f"core like '%{e}' and length(core) >= {STEM + len(e)}"
        stem, ending = f"case when {fits} then substr(core, 1, length(core) - {len(e)}) else {stem} end", f"case when {fits} then '{e}' else {ending} end"
    return f"cores as (select item_id, id, token, {d.replace('lower(token)', '[.,]', '')} as core from typed), parts as (select item_id, id, token, core, {stem} as stem, {ending} as ending from cores where core <> '')"


def word_features(d: Dialect) -> str:
    """Each word's core, parts, what its stem and ending cost, and whether it is marked or non-finite, with its place."""
    return f"""with {typed(d)}, {stems(d)}, every as (select count(*) as total from parts), s as (select stem, n, total from (select stem, count(*) as n from parts group by stem) q cross join every), e as (select ending, n, total from (select ending, count(*) as n from parts group by ending) q cross join every)
    select p.item_id, p.id, p.core, p.stem, p.ending, case when p.ending = '' then 1 else 2 end as morphs, round(-ln(s.n / cast(s.total as double)), 6) as stem_surprisal, round(-ln(e.n / cast(e.total as double)), 6) as ending_surprisal,
    case when p.ending <> '' then 1 else 0 end as marked, case when p.ending in ('ing', 'ed') then 1 else 0 end as non_finite, round(ln(s.n / cast(s.total as double) + 1e-9), 6) as lemma_freq, count(*) over (partition by p.item_id) as n_words from parts p join s on s.stem = p.stem join e on e.ending = p.ending"""


def text_morphology(d: Dialect) -> str:
    """A text's morphology over its words: parts a word, what stems and endings cost, marked words, lemma frequency, non-finite forms."""
    if d.spark:
        return f"with w as ({word_features(d)}) select item_id, count(*) as words, round(avg(morphs), 6) as morphs, round(avg(stem_surprisal), 5) as stem_surprisal, round(avg(case when ending <> '' then ending_surprisal end), 5) as ending_surprisal, round(avg(marked), 6) as marked, round(avg(lemma_freq), 5) as lemma_freq, cast(sum(non_finite) as bigint) as non_finite from w group by item_id"
    ends = ", ".join(f"'{e}'" for e in ENDINGS)
    return f"""with t as (select item_id, unnest(list_filter(list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda x: regexp_replace(lower(x), '[.,]', '', 'g')), lambda x: x <> '')) as core from {{benchmark}}),
    p as (select item_id, core, list_filter([{ends}], lambda e: ends_with(core, e) and length(core) >= length(e) + {STEM})[1] as e from t), s as (select item_id, coalesce(e, '') as ending, case when e is null then core else core[1:length(core) - length(e)] end as stem from p),
    c as (select *, count(*) over (partition by stem) as ns, count(*) over (partition by ending) as ne, count(*) over () as total from s)
    select item_id, count(*) as words, round(avg(case when ending = '' then 1e0 else 2e0 end), 6) as morphs, round(avg(round(-ln(ns / cast(total as double)), 6)), 5) as stem_surprisal, round(avg(case when ending <> '' then round(-ln(ne / cast(total as double)), 6) end), 5) as ending_surprisal, round(avg((ending <> '')::int), 6) as marked,
    round(avg(round(ln(ns / cast(total as double) + 1e-9), 6)), 5) as lemma_freq, cast(sum((ending in ('ing', 'ed'))::int) as bigint) as non_finite from c group by item_id"""


def lexical_row(d: Dialect) -> str:
    """A feature row of a word that only its letters and frequency fill; what contexts would tell is 0."""
    return f"""with {typed(d)}, u as (select word, count(*) as c from typed where word <> '' group by word), every as (select sum(cast(c as double) * c) as total from u) select t.item_id, t.id, length(t.word) as wlen, round(ln(u.c / every.total + 1e-9), 6) as freq, 0e0 as fwd, 0e0 as bwd, 0e0 as surprisal, 0e0 as entropy, 0 as depth
    from typed t join u on u.word = t.word cross join every"""


def tag_alignment(d: Dialect) -> str:
    """Tags of letter runs laid beside the words between blanks: by place, cut or padded with NN where the numbers differ."""
    runs = r"regexp_extract_all(text, r'\p{L}+', 0)" if d.spark else r"regexp_extract_all(text, '\p{L}+')"
    size = "size" if d.spark else "len"
    pick = f"try_element_at({runs}, t.id)" if d.spark else f"({runs})[t.id]"
    return f"""with {typed(d)}, n as (select item_id, count(*) as words from typed group by item_id) select t.item_id, t.id, t.token, case when {pick} is null then 'NN' when length({pick}) <= 3 then 'DT' else 'NN' end as tag, case when n.words = {size}({runs}) then 1 else 0 end as aligned
    from typed t join n on n.item_id = t.item_id join {{benchmark}} b on b.item_id = t.item_id"""


def region_words(d: Dialect) -> str:
    """Regions between commas as words with a running place; words of the critical region are marked."""
    blank = chr(92) + "s+"
    if d.spark:
        regions = "select item_id, posexplode(split(text, ',')) as (r, region) from {benchmark}"
        words = f"select item_id, r, posexplode(split(trim(region), r'{blank}')) as (k, word) from regions"
    else:
        regions = "select item_id, unnest(range(len(string_split(text, ',')))) as r, unnest(string_split(text, ',')) as region from {benchmark}"
        words = f"select item_id, r, unnest(range(len(regexp_split_to_array(trim(region), '{blank}')))) as k, unnest(regexp_split_to_array(trim(region), '{blank}')) as word from regions"
    return f"with regions as ({regions}), words as ({words}) select item_id, cast(row_number() over (partition by item_id order by r, k) as int) as place, word, cast(r as int) as region, case when r = 1 then 1 else 0 end as critical from words where word <> ''"


def item_table(d: Dialect) -> str:
    """Practice items and sentences in one table, answers as Y and N; the second practice item asks for its longest word."""
    return f"""with {typed(d)}, longest as (select item_id, word from (select item_id, word, row_number() over (partition by item_id order by length(word) desc, id) as rn from typed) q where rn = 1),
    every as (select 'practice' as kind, item_id, text, case when item_id % 2 = 0 then 'yes' else 'no' end as answer from {{benchmark}} where item_id < 3 union all select 'item' as kind, item_id, text, case when item_id % 3 = 0 then 'yes' else 'no' end as answer from {{benchmark}} where item_id >= 3)
    select e.kind, e.item_id, length(e.text) as chars, case when e.answer = 'yes' then 'Y' else 'N' end as answer, case when e.kind = 'practice' and e.item_id = 1 then concat('Was there the word ', l.word, '?') else '' end as question from every e join longest l on l.item_id = e.item_id"""


def score_table(d: Dialect) -> str:
    """Each first turn with each answer to it: both texts' features and scores, and the change."""
    s = chr(92)
    words = d.count_matches("text", s + "S+")
    return f"""with x as (select conv_id, turn, {words} as words, length(text) as chars, 0.05e0 * {words} + 0.01e0 * length(text) as score from {{conversations}} where text is not null)
    select a.conv_id, b.turn as system, a.words as words_before, b.words as words_after, a.chars as chars_before, b.chars as chars_after, round(a.score, 6) as before, round(b.score, 6) as after_, round(b.score - a.score, 6) as change, case when b.score < a.score then 'easier' when b.score > a.score then 'harder' else 'same' end as verdict
    from x a join x b on b.conv_id = a.conv_id and a.turn = 0 and b.turn > 0"""


def pair_cards(d: Dialect) -> str:
    """Rating means and shares of the stored pairs of some sources."""
    return """select o.source, o.lang, count(*) as ratings, round(avg(l.quality), 6) as meaning, round(avg(case when l.toxic = 1 then 1e0 else 0e0 end), 6) as share_toxic, round(avg(case when l.quality = 1 and l.toxic = 0 then 1e0 else 0e0 end), 6) as share_good
    from {labels} l join {documents} o on o.doc_id = l.doc_id where o.source in ('src1', 'src2', 'src3') group by o.source, o.lang"""


def surprisal_or_mean(d: Dialect) -> str:
    """A column joined from another table, its mean where it is missing; the mean is of one row, joined back."""
    return """with j as (select o.doc_id, cast(l.quality as double) as x from {documents} o left join {labels} l on l.doc_id = o.doc_id), m as (select avg(x) as m from j) select doc_id, round(coalesce(x, m), 6) as x, case when x is null then 1 else 0 end as imputed from j cross join m"""


def simplification_summary(d: Dialect, draws: int = DRAWS) -> str:
    """Share that became easier, mean drop with its interval, means before and after, splits and copies."""
    s = chr(92)
    words = d.count_matches("text", s + "S+")
    return f"""with x as (select conv_id, turn, text, {words} as words, length(text) as chars, {d.count_matches("text", "[.!?]")} as stops from {{conversations}} where turn < 2 and text is not null),
    p as (select a.conv_id, a.words as wa, b.words as wb, a.chars as ca, b.chars as cb, a.stops as sa, b.stops as sb, a.chars - b.chars as fall, case when a.text = b.text then 1 else 0 end as same from x a join x b on b.conv_id = a.conv_id and a.turn = 0 and b.turn = 1),
    r as ({draws_of(d, "p", "fall", ("'drop'", "draw", "conv_id"), draws=draws)}), m as (select draw, sum(fall * times) / cast(nullif(sum(times), 0) as double) as mean_fall from r group by draw),
    i as (select {d.pct('mean_fall', 0.025)} as low, {d.pct('mean_fall', 0.975)} as high from m)
    select count(*) as pairs, round(avg(case when fall > 0 then 1e0 else 0e0 end), 6) as easier, round(avg(fall), 6) as mean_fall, round(max(low), 6) as low, round(max(high), 6) as high, round(avg(wa), 6) as words_before, round(avg(wb), 6) as words_after, sum(case when sb > sa then 1 else 0 end) as splits, cast(sum(same) as bigint) as copies from p cross join i"""


def simplification_interval(frames: dict, draws: int = DRAWS) -> DataFrame:
    turns = frames["conversations"].filter("turn < 2 and text is not null").select("conv_id", "turn", "text", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("words"), F.length("text").alias("chars"), F.size(F.regexp_extract_all("text", F.lit("[.!?]"), F.lit(0))).alias("stops"))
    both = turns.filter("turn = 0").alias("a").join(turns.filter("turn = 1").alias("b"), "conv_id")
    pairs = both.select("conv_id", F.col("a.words").alias("wa"), F.col("b.words").alias("wb"), (F.col("a.chars") - F.col("b.chars")).alias("fall"), (F.col("b.stops") > F.col("a.stops")).cast("int").alias("split"), (F.col("a.text") == F.col("b.text")).cast("int").alias("same"))
    drawn = resampled(pairs, [("drop", ["conv_id"])], ["fall"], draws=draws).select(ratio("fall").alias("m"))
    low, high = interval(F.col("m"), 0.025, 0.975)
    mean = lambda x: F.round(F.avg(x), 6)
    whole = pairs.agg(
        F.count(F.lit(1)).alias("pairs"), mean(F.when(F.col("fall") > 0, 1.0).otherwise(0.0)).alias("easier"), mean("fall").alias("mean_fall"), mean("wa").alias("words_before"), mean("wb").alias("words_after"),
        F.sum("split").alias("splits"), F.sum("same").alias("copies"))
    return whole.crossJoin(drawn.agg(low.alias("low"), high.alias("high")))


def landing_place(d: Dialect) -> str:
    """Letter that a fixation lands on, in the box with its marks and in the bare word, and its column: 0 left of the box."""
    return """with x as (select user_id, i, w + 3 as olen, 1 as omarks, w + 1 as wlen, 10 * w as start_x, (d - 5) / 100e0 as share from {fix}), y as (select *, case when share < 0 then 0 else least(olen, cast(floor(share * olen) as int) + 1) end as oblp from x)
    select user_id, i, oblp, greatest(0, least(wlen, oblp - omarks)) as wdlp, start_x + oblp as xpos from y"""


def latest_session(d: Dialect) -> str:
    """All rows of the latest session, or of the one asked for; a session that isn't there is an error."""
    fail = "raise_error('no session')" if d.spark else "error('no session')"
    return f"with l as (select coalesce(max(cast(floor(t / 86400) as bigint)), {fail}) as session from {{fix}}) select f.user_id, f.i, round(f.d, 4) as d from {{fix}} f join l on cast(floor(f.t / 86400) as bigint) = l.session"


def line_places(d: Dialect) -> str:
    """A word's place in its line, the line's size, and whether it is the first or last on it."""
    return f"""with {typed(d)}, l as (select item_id, id, token, cast(floor((id - 1) / 8e0) as int) as line from typed) select item_id, id, line, cast(rank() over (partition by item_id, line order by id) as int) as place, cast(count(*) over (partition by item_id, line) as int) as words,
    case when id = max(id) over (partition by item_id, line) then 1 else 0 end as last_, case when id = min(id) over (partition by item_id, line) then 1 else 0 end as first_ from l"""


def word_places(d: Dialect) -> str:
    """Fixated words looked up in the layout by item and serial: line and column."""
    return f"""with {scripted_reader(d)}, layout as (select item_id, id as serial, cast(floor((id - 1) / 8e0) as int) as line, cast(coalesce(sum(length(token) + 1) over (partition by item_id order by id rows between unbounded preceding and 1 preceding), 0) as int) as start_col from typed)
    select s.item_id, s.i, s.w as serial, l.line, l.start_col, coalesce(l.start_col, -99) + 1 as xpos from script s left join layout l on l.item_id = s.item_id and l.serial = s.w"""


def coverage_shares(d: Dialect) -> str:
    """Shares of word types that a lexicon, a guess or nothing covers, and of those that both cover."""
    guess = " or ".join(f"w.word like '%{e}'" for e in ENDINGS)
    return f"""with w as (select word, count(*) as n from {{tok}} group by word), c as (select w.word, w.n, l.word is not null as known, ({guess}) as guessed from w left join {{lex}} l on l.word = w.word)
    select count(*) as types, round(avg(case when known then 1e0 else 0e0 end), 6) as lexicon, round(avg(case when not known and guessed then 1e0 else 0e0 end), 6) as guesser, round(avg(case when not known and not guessed then 1e0 else 0e0 end), 6) as none, round(avg(case when known and guessed then 1e0 else 0e0 end), 6) as ambiguous, round(sum(case when known then n else 0 end) / cast(sum(n) as double), 6) as token_share from c"""


def stable_features(d: Dialect) -> str:
    """Each feature's population spread within and between targets, and how its targets' means go with the targets' places."""
    places = "label % 3 as tx, cast(floor(label / 3e0) as int) as ty"
    if d.spark:
        return f"""with g as (select k, label, {places}, avg(x) as m, var_pop(x) as v from {{dims}} group by k, label)
    select k, round(sqrt(avg(v)), 6) as within_sd, round(stddev_pop(m), 6) as between_sd, round(stddev_pop(m) / nullif(sqrt(avg(v)), 0), 6) as ratio, round(corr(m, tx), 6) as r_x, round(corr(m, ty), 6) as r_y from g group by k"""
    r = lambda t: f"round((avg(m * {t}) - avg(m) * avg({t})) / (sqrt(avg(m * m) - avg(m) * avg(m)) * sqrt(avg({t} * {t}) - avg({t}) * avg({t}))), 6)"
    return f"""with c as (select *, x - avg(x) over (partition by k, label) as off_ from {{dims}}), g as (select k, label, {places}, avg(x) as m, avg(off_ * off_) as v from c group by k, label), o as (select *, m - avg(m) over (partition by k) as dm from g)
    select k, round(sqrt(avg(v)), 6) as within_sd, round(sqrt(avg(dm * dm)), 6) as between_sd, round(sqrt(avg(dm * dm) / avg(v)), 6) as ratio, {r('tx')} as r_x, {r('ty')} as r_y from o group by k"""


def reader_checks(d: Dialect) -> str:
    """Readers that stay: those on a list whatever their answers, else those right often enough; practice doesn't count."""
    return """with f as (select * from {fix} where i > 5), a as (select user_id, count(*) as n, avg(case when event_type <> 'error' then 1e0 else 0e0 end) as accuracy from f group by user_id)
    select user_id, n, round(accuracy, 6) as accuracy, case when user_id in (2, 4) then 'listed' when accuracy >= 0.8 then 'kept' else 'dropped' end as verdict from a"""


def sentence_quality(d: Dialect) -> str:
    """Why a reader's sentence is left out: few valid samples, much off the text, no word at all."""
    return """with q as (select user_id, floor((i - 1) / 20.0) as sid, avg(case when event_type = 'error' then 0e0 else 1e0 end) as valid, avg(case when w >= 6 then 1e0 else 0e0 end) as off_text, sum(case when w < 6 and d <= 1200 then 1 else 0 end) as on_word, sum(case when d > 1200 then 1 else 0 end) as too_long from {fix} group by user_id, floor((i - 1) / 20.0))
    select user_id, cast(sid as bigint) as sid, round(valid, 6) as valid, round(off_text, 6) as off_text, on_word, too_long, concat_ws('; ', case when valid < 0.7 then 'low valid share' end, case when off_text > 0.5 then 'off text' end, case when on_word = 0 then 'no word' end) as reasons from q"""


#: Words of one or two letters that are whole, and endings of sentences that tell a pupil what to do: values of the query.
SHORT_WORDS = "a an as at be by de di do du el en er es et he ha id if il im in is it je la le lo me my no of oh ok on or ou qu sa se si so su te to tu un up us we y yo zu".split()
INSTRUCTIONS = ("schreibe", "write", "lisez", "escribe")


def clean_rules(d: Dialect, low: int = 4, high: int = 40) -> str:
    """The rules that a sentence breaks, in order: words, broken characters, a sign without its letter at the start, impossible sequences,
    exercise marks, an instruction at the end, fragments (short words that aren't on the list), words that begin as none does, foreign letters, other tokens."""
    s = chr(92)
    words, letters = d.count_matches("sentence", s + "S+"), d.count_matches("sentence", s + "p{L}+")
    foreign = f"({d.count_matches('sentence', s + 'p{L}')} - {d.count_matches('sentence', '[A-Za-zÀ-ɏ]')})"
    triple = "|".join(3 * c for c in "abcdefghijklmnopqrstuvwxyz")
    runs = f"regexp_extract_all(lower(sentence), {'r' if d.spark else ''}'{s}p{{L}}+'{', 0' if d.spark else ''})"
    listed = ", ".join(f"'{w}'" for w in SHORT_WORDS)
    starts = ", ".join(f"'{c}'" for c in NO_START)
    if d.spark:
        some = lambda test: f"exists(runs, w -> {test})"
    else:
        some = lambda test: f"len(list_filter(runs, lambda w: {test})) > 0"
    rules = {
        "length": f"words not between {low} and {high}", "broken": d.matches("sentence", "\ufffd"), "start": d.matches("sentence", "^" + s + "p{M}"), "sequence": d.matches("lower(sentence)", triple),
        "exercise": d.matches("sentence", "[_|#*%&]{2}|[.]{3}|[0-9]+[)]"), "instruction": d.matches("lower(sentence)", f"({'|'.join(INSTRUCTIONS)})[.!]?$"),
        "fragments": some(f"length(w) <= 2 and w not in ({listed})"), "initial": some(f"substr(w, 1, 1) in ({starts})"), "letters": "others > 0.1 * length(sentence)", "tokens": "letters < 0.8 * words"}
    broken = ", ".join(f"case when {test} then '{name}' end" for name, test in rules.items())
    return f"with x as (select doc_id, sid, sentence, {words} as words, {letters} as letters, {foreign} as others, {runs} as runs from {{sent}}) select doc_id, sid, concat_ws('; ', {broken}) as broken from x"


def deduped_pairs(d: Dialect) -> str:
    """Distinct answers of a conversation in order, without those equal to its first turn, and how many went."""
    return """with a as (select conv_id, turn, text, row_number() over (partition by conv_id, text order by turn) as copy from {conversations} where text is not null), s as (select conv_id, text from {conversations} where turn = 0),
    k as (select a.conv_id, a.turn, case when a.copy = 1 and (s.text is null or a.text <> s.text) then 1 else 0 end as kept from a left join s on s.conv_id = a.conv_id where a.turn > 0)
    select conv_id, turn, row_number() over (partition by conv_id order by turn) as place, (select count(*) from k k2 where k2.kept = 0) as dropped from k where kept = 1"""


def whitelist_tags(d: Dialect) -> str:
    """Leaf tags of bracket trees in order, those of a list only."""
    tree = "concat('(S ', {join}, ')')"
    if d.spark:
        made = r"array_join(transform(regexp_extract_all(lower(text), r'\p{L}+', 0), w -> concat('(', case when length(w) <= 3 then 'DT' when w like '%ly' then 'RB' else 'NN' end, ' ', w, ')')), ' ')"
        return f"with t as (select item_id, {tree.format(join=made)} as tree from {{benchmark}}) select item_id, array_join(filter(regexp_extract_all(tree, r'\\(([A-Z]+) [^()]+\\)', 1), x -> array_contains(array('NN', 'DT'), x)), ' ') as tags from t"
    made = r"array_to_string(list_transform(regexp_extract_all(lower(text), '\p{L}+'), lambda w: concat('(', case when length(w) <= 3 then 'DT' when w like '%ly' then 'RB' else 'NN' end, ' ', w, ')')), ' ')"
    return f"with t as (select item_id, {tree.format(join=made)} as tree from {{benchmark}}) select item_id, array_to_string(list_filter(regexp_extract_all(tree, '\\(([A-Z]+) [^()]+\\)', 1), lambda x: list_contains(['NN', 'DT'], x)), ' ') as tags from t"


QUERIES = {f.__name__: SqlQuery(f) for f in (
    word_rows, session_relabel, aligned_join, sentence_means, participant_summary, word_means, any_overlap, ptb_tokens, mark_codes, eligible, plain_sentences,
    visual_angle, date_stamps, feature_pairs, typed_features, explanation, profile_verdict, fixated_only, threshold_grid, word_wrap, simulated_log,
    truth_agreement, question_scoring, word_features, text_morphology, lexical_row, tag_alignment, region_words, item_table, score_table, pair_cards, surprisal_or_mean, landing_place,
    latest_session, line_places, word_places, coverage_shares, stable_features, reader_checks, sentence_quality, clean_rules, deduped_pairs, whitelist_tags)}
QUERIES["simplification_summary"] = FrameQuery(simplification_summary, simplification_interval, ("conversations",))
FRAMES: dict = {}
