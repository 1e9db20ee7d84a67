"""The queries of the operators over the derived relations, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions import geometry as geo
from ..operators import admission, annotations, audit, inference, integrity, jitter, matching, quality, results, scoring, signals, splits
from ..operators.ordering import batches, even_sample
from ..session import checkpoint as saved
from ..session import shared_dir
from ..schema import CLASS_NAMES, MatchingConfig, StoppingConfig
from ..sources.store import read_buckets, write_buckets
from . import fixtures as fx
from . import oracle as o
from .rounds import bank_rows, bootstrap_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x) -> F.Column:
    return F.round(x, 6) + 0.0


def r9(x) -> F.Column:
    """Nine places, where six would meet ties of sixteenths of a pixel."""
    return F.round(x, 9) + 0.0


def q9(x: str) -> str:
    return f"round({x}, 9) + 0.0::double"


def q6(x: str) -> str:
    return f"round({x}, 6) + 0.0::double"


def pair(spark: SparkSession, sf: str, t: int) -> tuple[DataFrame, DataFrame]:
    return fx.detections(spark, sf, t), fx.detections(spark, sf, t - 1)


def matched(spark: SparkSession, sf: str, t: int) -> DataFrame:
    return matching.match(*pair(spark, sf, t))


def scored(spark: SparkSession, sf: str, t: int) -> DataFrame:
    return scoring.score(matched(spark, sf, t))


#: CTE s1 of scored boxes of round 1 without jitter, after m1.
SCORED = """sc1 as (select *, case when status = 'matched' then 1 - js end as c_cls, case when status = 'matched' then iou end as c_loc,
    case when status = 'matched' then least(greatest(0.33::double * (1 - js) + 0.33::double * iou + 0.34::double * 0, 0.0::double), 1.0::double) end as s from m1)"""
M1 = f"with recursive {o.rounds(0, 1)},\n{o.matches(1, 0)}"


@query(f"""with {o.rounds(1)}, {o.OBJ.replace("obj as", "obj2 as", 1)} select pred_class, count(*) as n, {q6("avg(confidence)")} as mean_confidence from d1 group by pred_class""")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes per class of round 1."""
    return fx.detections(spark, sf, 1).groupBy("pred_class").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("mean_confidence"))


@query(f"""with {o.rounds(0, 1)} select t.box_id as box_id_t, p.box_id as box_id_prev, {q6(o.iou("t.", "p."))} as iou
from d1 t join d0 p on t.image_id = p.image_id""")
def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    t, p = pair(spark, sf, 1)
    a = t.select("image_id", F.col("box_id").alias("box_id_t"), F.col("box").alias("a"))
    b = p.select("image_id", F.col("box_id").alias("box_id_prev"), F.col("box").alias("b"))
    return a.join(b, "image_id").select("box_id_t", "box_id_prev", r6(geo.iou(F.col("a"), F.col("b"))).alias("iou"))


@query(f"""with {o.rounds(0, 1)}, n as (select t.box_id as box_id_t, p.box_id as box_id_prev, {o.normalize("t.p")} as a, {o.normalize("p.p")} as b
from d1 t join d0 p on t.image_id = p.image_id) select box_id_t, box_id_prev, {q6(o.jsd("a", "b"))} as js from n""")
def jsd_pairs(spark: SparkSession, sf: str) -> DataFrame:
    t, p = pair(spark, sf, 1)
    a = t.select("image_id", F.col("box_id").alias("box_id_t"), F.col("class_scores").alias("a"))
    b = p.select("image_id", F.col("box_id").alias("box_id_prev"), F.col("class_scores").alias("b"))
    return a.join(b, "image_id").select("box_id_t", "box_id_prev", r6(dist.js_divergence(F.col("a"), F.col("b"))).alias("js"))


@query(f"""with {o.rounds(0)}, n as (select box_id, {o.normalize("list_transform(p, lambda x: x * 3)")} as q from d0)
select box_id, {", ".join(f"{q6(f'q[{k + 1}]')} as q{k}" for k in range(5))} from n""")
def class_normalize(spark: SparkSession, sf: str) -> DataFrame:
    q = dist.normalize(F.transform("class_scores", lambda x: x * 3))
    return fx.detections(spark, sf, 0).select("box_id", q.alias("q")).select("box_id", *[r6(F.get("q", F.lit(k))).alias(f"q{k}") for k in range(5)])


@query(f"""with {o.rounds(0, 1)}, {o.edges(1, 0)} select bt as box_id_t, bp as box_id_prev, {q6("iou")} as iou, {q6("js")} as js, {q6("cost")} as cost from e1""")
def gated_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = matching.candidate_edges(*pair(spark, sf, 1))
    return e.select("box_id_t", "box_id_prev", *[r6(F.col(c)).alias(c) for c in ("iou", "js", "cost")])


@query(f"""with {o.rounds(0, 1)}, {o.edges(1, 0)}, g as (select bt, count(*) as n, list_sort(list(cost)) as c from e1 group by bt)
select bt as box_id_t, n as candidates, {q6("c[1]")} as best, {q6("c[2]")} as second from g""")
def second_best_cost(spark: SparkSession, sf: str) -> DataFrame:
    e = matching.two_best_costs(matching.candidate_edges(*pair(spark, sf, 1)))
    return e.select("box_id_t", F.col("candidates").cast("long").alias("candidates"), r6(F.col("best")).alias("best"), r6(F.col("second")).alias("second"))


@query(f"""{M1} select box_id_t, bp as box_id_prev, {q6("iou")} as iou, {q6("js")} as js from m1 where status = 'matched'""")
def assign_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf, 1).where("status = 'matched'").select("box_id_t", "box_id_prev", r6(F.col("iou")).alias("iou"), r6(F.col("js")).alias("js"))


@query(f"""{M1} select box_id_t, status, candidates from m1""")
def match_status(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf, 1).select("box_id_t", "status", F.col("candidates").cast("long").alias("candidates"))


@query(f"""{M1}, p as (select image_id, count(*) filter (status = 'matched') as matched, count(*) filter (status = 'unmatched') as unmatched, count(*) filter (status = 'ambiguous') as ambiguous from m1 group by image_id),
{o.IMAGES} select i.image_id, coalesce(matched, 0) as n_matched, coalesce(unmatched, 0) as n_unmatched, coalesce(ambiguous, 0) as n_ambiguous from images i left join p on p.image_id = i.image_id""")
def match_results(spark: SparkSession, sf: str) -> DataFrame:
    nested = matching.nested_matches(matched(spark, sf, 1), fx.images(spark, sf))
    return nested.select(
        "image_id", *[F.size(c).cast("long").alias(n) for c, n in (("matched_pairs", "n_matched"), ("unmatched_current", "n_unmatched"), ("ambiguous", "n_ambiguous"))]
    )


@query(f"""with {o.rounds(0, 1)}, a as (select distinct image_id from d1), b as (select distinct image_id from d0)
select coalesce(a.image_id, b.image_id) as image_id, a.image_id is not null as in_t, b.image_id is not null as in_prev from a full join b on a.image_id = b.image_id""")
def image_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return matching.image_alignment(*pair(spark, sf, 1))


@query(f"""{M1}, {SCORED} select box_id_t, {q6("c_cls")} as c_cls_dist, {q6("c_loc")} as c_loc, case when status = 'matched' then 0.0::double end as c_jitter_loc, {q6("s")} as stability from sc1""")
def stability_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf, 1).select("box_id_t", *[r6(F.col(c)).alias(c) for c in ("c_cls_dist", "c_loc", "c_jitter_loc", "stability")])


@query(f"""{M1}, {SCORED} select box_id_t, pred_class_t as pred_class, {q6("s")} as stability, {q6("confidence")} as confidence from sc1 where s >= 0.6 and confidence >= 0.4""")
def admit_dual(spark: SparkSession, sf: str) -> DataFrame:
    kept = admission.admitted_boxes(scored(spark, sf, 1), admission.dual_gate())
    return kept.select("box_id_t", F.col("pred_class_t").alias("pred_class"), r6(F.col("stability")).alias("stability"), r6(F.col("confidence")).alias("confidence"))


@query(f"""with {o.rounds(1)} select image_id, det_index, pred_class, lpad(cast(row_number() over (order by image_id, det_index) - 1 as varchar), 5, '0') as number from d1 where confidence >= 0.5""")
def admit_conf(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.ordering import numbered_by

    kept = fx.detections(spark, sf, 1).where(admission.confidence_gate(0.5)(None))
    number = F.col("position").cast("string")
    return numbered_by(kept, "image_id", "det_index").select("image_id", F.col("det_index").cast("long").alias("det_index"), "pred_class", F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number).alias("number"))


SQL["admit_conf"] = SQL["admit_conf"].replace("lpad(cast(row_number() over (order by image_id, det_index) - 1 as varchar), 5, '0')", "format('{:05d}', row_number() over (order by image_id, det_index) - 1)")

CHURN = """select (select count(*) from d{t}) as n_t, (select count(*) from d{r}) as n_prev, count(*) filter (status = 'matched') as n_matched, count(*) filter (status = 'ambiguous') as n_ambiguous,
    count(*) filter (status = 'unmatched') as n_new, (select count(*) from d{r}) - count(*) filter (status = 'matched') as n_removed,
    count(*) filter (status = 'matched' and pred_class_t <> cp) as n_class_change, count(*) filter (status = 'matched' and iou < 0.5) as n_geom_change from m{t}"""


def churn_of(spark: SparkSession, sf: str, t: int) -> DataFrame:
    n_prev = fx.detections(spark, sf, t - 1).agg(F.count("*").alias("n_prev"))
    return signals.churn_parts(matched(spark, sf, t), n_prev, StoppingConfig().tau_geom_change)


@query(f"""{M1}, c as ({CHURN.format(t=1, r=0)}) select *, {q6("(n_new + n_removed + n_class_change + n_geom_change)::double / (n_t + n_prev - n_matched)")} as raw_churn from c""")
def round_churn(spark: SparkSession, sf: str) -> DataFrame:
    return churn_of(spark, sf, 1).withColumn("raw_churn", r6(F.col("raw_churn")))


@query(f"""{M1}, {SCORED} select count(*) filter (s >= 0.6 and confidence >= 0.4) as n_admitted, count(*) as n_t, {q6("count(*) filter (s >= 0.6 and confidence >= 0.4)::double / count(*)")} as stable_yield from sc1""")
def stable_yield(spark: SparkSession, sf: str) -> DataFrame:
    return signals.stable_yield(admission.admit(scored(spark, sf, 1), admission.dual_gate())).withColumn("stable_yield", r6(F.col("stable_yield")))


DRIFT = f"""h as (select [{", ".join(f"(select count(*) from d{{t}} where pred_class = {k})::double" for k in range(5))}] as a, [{", ".join(f"(select count(*) from d{{r}} where pred_class = {k})::double" for k in range(5))}] as b),
hn as (select {o.normalize("a")} as a, {o.normalize("b")} as b from h)"""


@query(f"""with {o.rounds(0, 1)}, {DRIFT.format(t=1, r=0)} select {"round(" + o.jsd("a", "b") + ", 9)"} as class_drift from hn""")
def class_drift(spark: SparkSession, sf: str) -> DataFrame:
    t, p = pair(spark, sf, 1)
    return signals.class_drift(t, p, fx.CLASSES).select(F.round("class_drift", 9).alias("class_drift"))


#: Rounds made of a hundred events each, in the order of their ids: shares of their kinds stand for the signals.
HISTORY_SQL = """h as (select cast(event_id // 100 as integer) + 1 as round_id, count(*) filter (event_type = 'error')::double / count(*) as raw_churn,
    count(*) filter (event_type = 'click')::double / count(*) as stable_yield, count(*) filter (event_type = 'signup')::double / (4 * count(*)) as class_drift from events group by 1)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda kind, of=1: F.count_if(F.col("event_type") == kind).cast("double") / (of * F.count("*"))
    rounds = fx.read(spark, sf, "events").groupBy((F.expr("event_id div 100") + 1).cast("int").alias("round_id"))
    return rounds.agg(share("error").alias("raw_churn"), share("click").alias("stable_yield"), share("signup", 4).alias("class_drift"))


DELTAS = f"""with {HISTORY_SQL}, l as (select *, lag(raw_churn) over w as pc, lag(stable_yield) over w as py, lag(class_drift) over w as pd from h window w as (order by round_id)),
x as (select *, coalesce(round_id > 2 and pc is not null and abs(raw_churn - pc) < 0.05 and (abs(stable_yield - py) < 0.06 or stable_yield < 0.05) and (abs(class_drift - pd) < 0.02 or class_drift > 0.1), false) as met from l),
y as (select *, sum(case when met then 0 else 1 end) over (order by round_id) as island from x),
z as (select *, cast(sum(case when met then 1 else 0 end) over (partition by island order by round_id rows unbounded preceding) as integer) as consecutive from y)"""


#: Wide enough that some rounds meet them.
LOOSE = StoppingConfig(epsilon_churn=0.05, epsilon_yield=0.06, epsilon_drift=0.02)


@query(f"""{DELTAS} select round_id, {q6("abs(raw_churn - pc)")} as d_churn, {q6("abs(stable_yield - py)")} as d_yield, {q6("abs(class_drift - pd)")} as d_drift, met from z""")
def signal_deltas(spark: SparkSession, sf: str) -> DataFrame:
    d = signals.signal_deltas(history(spark, sf), LOOSE)
    return d.select("round_id", *[r6(F.col(c)).alias(c) for c in ("d_churn", "d_yield", "d_drift")], "met")


@query(f"""{DELTAS} select round_id, consecutive, consecutive >= 2 as stop from z""")
def stop_counter(spark: SparkSession, sf: str) -> DataFrame:
    return signals.signal_deltas(history(spark, sf), LOOSE).select("round_id", "consecutive", "stop")


@query(f"""{DELTAS} select round_id, coalesce(raw_churn > 0.22 and stable_yield > py, false) as risk_stop from z""")
def risk_stop(spark: SparkSession, sf: str) -> DataFrame:
    return signals.signal_deltas(history(spark, sf), StoppingConfig(tau_risk_churn=0.22)).select("round_id", "risk_stop")


def clip_sql(x1: str, y1: str, x2: str, y2: str) -> dict[str, str]:
    c = {k: f"least(greatest({v}, 0.0::double), {hi}.0::double)" for k, v, hi in (("x1", x1, 640), ("y1", y1, 480), ("x2", x2, 640), ("y2", y2, 480))}
    return {"x1": f"least({c['x1']}, {c['x2']})", "y1": f"least({c['y1']}, {c['y2']})", "x2": f"greatest({c['x1']}, {c['x2']})", "y2": f"greatest({c['y1']}, {c['y2']})"}


REMAP_SQL = {
    "scale": clip_sql("320 + (x1 - 320) * 1.03::double", "240 + (y1 - 240) * 1.03::double", "320 + (x2 - 320) * 1.03::double", "240 + (y2 - 240) * 1.03::double"),
    "translate": clip_sql("x1 + 8", "y1 + 8", "x2 + 8", "y2 + 8"),
    "brightness": clip_sql("x1", "y1", "x2", "y2"),
}


@query(f"""with {o.rounds(1)} """ + " union all ".join(f"select box_id, '{t}' as transform, " + ", ".join(f"{q6(e)} as {c}" for c, e in m.items()) + " from d1" for t, m in REMAP_SQL.items()))
def jitter_remap(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.detections(spark, sf, 1)
    size = F.lit(fx.WIDTH), F.lit(fx.HEIGHT)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("transform"), geo.remap(F.col("box"), *size, t).alias("b")) for t in jitter.TRANSFORMS]))
    return d.select("box_id", each.alias("x")).select("box_id", "x.transform", *[r6(F.col(f"x.b.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")])


def jitter_found(spark: SparkSession, sf: str, t: int, lines: DataFrame | None = None) -> DataFrame:
    """What the transformed images hold, of one pass over the boxes."""
    size, shift = (F.lit(fx.WIDTH), F.lit(fx.HEIGHT)), F.col("shift")
    moved = fx.jittered(spark, sf, t, len(jitter.TRANSFORMS), lines)
    at = F.get(F.array(*[geo.remap(F.col("box"), *size, name) for name in jitter.TRANSFORMS]), F.col("transform"))
    b = moved.select("image_id", "transform", "pred_class", "shift", at.alias("b"))
    return b.select("image_id", "transform", geo.box(F.col("b.x1") + shift, F.col("b.y1") + shift, F.col("b.x2") + shift, F.col("b.y2") + shift).alias("box"), "pred_class")


def jittered_matches(spark: SparkSession, sf: str, t: int) -> tuple[DataFrame, DataFrame]:
    """Matches and their triples. Line items are numbered once and matched once, both saved in buckets by image."""
    lines = fx.saved_objects(spark, sf)
    current, previous = (fx.detections(spark, sf, r, lines=lines) for r in (t, t - 1))
    m, place = matching.match(current, previous, keep=["box"]), f"{shared_dir(spark)}/matches-{uuid.uuid4().hex}"
    m = m.select("image_id", "box_id_t", "status", "iou", "js", "pred_class_t", "box")
    m = read_buckets(spark, place, m.schema, write_buckets(m, place))
    wanted = jitter.jitter_candidates(m, current, fx.images(spark, sf), MatchingConfig().min_iou_gate)
    return m, jitter.jitter_triples(wanted, jitter_found(spark, sf, t, lines), MatchingConfig().min_iou_gate)


def _jitter_sql() -> str:
    parts = []
    for k, (_, m) in enumerate(REMAP_SQL.items()):
        parts.append(f"f{k} as (select image_id, {', '.join(f'{e} + (l_partkey + {k}) % 5 as {c}' for c, e in m.items())}, cast((pred_class + case when (l_partkey + {k}) % 13 = 0 then 1 else 0 end) % 5 as integer) as cls from d1 where (l_suppkey + {k}) % 11 <> 0)")
        parts.append(f"w{k} as (select d.image_id, d.box_id, pred_class, {', '.join(f'{e} as {c}' for c, e in m.items())} from d1 d join m1 on m1.image_id = d.image_id and box_id_t = box_id where status = 'matched' and iou >= 0.3)")
        parts.append(f"j{k} as (select w.box_id, max({o.iou('w.', 'f.')}) as iou_{k} from w{k} w join f{k} f on f.image_id = w.image_id and f.cls = w.pred_class group by w.box_id having max({o.iou('w.', 'f.')}) >= 0.3)")
    return ",\n".join(parts)


@query(f"""{M1}, {_jitter_sql()} select j0.box_id, {q6("iou_0")} as iou_0, {q6("iou_1")} as iou_1, {q6("iou_2")} as iou_2 from j0 join j1 on j1.box_id = j0.box_id join j2 on j2.box_id = j0.box_id""")
def jitter_select(spark: SparkSession, sf: str) -> DataFrame:
    _, out = jittered_matches(spark, sf, 1)
    return out.select("box_id", *[r6(F.col(f"iou_{k}")).alias(f"iou_{k}") for k in range(3)])


@query(f"""{M1}, {_jitter_sql()}, j as (select j0.box_id, iou_0 as a, iou_1 as b, iou_2 as c, (iou_0 + iou_1 + iou_2) / 3 as m from j0 join j1 on j1.box_id = j0.box_id join j2 on j2.box_id = j0.box_id),
k as (select box_id, 1 - sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3) as jit from j)
select box_id_t, k.box_id is not null as jitter_executed, {q6("case when status = 'matched' then coalesce(jit, 0.0::double) end")} as c_jitter_loc,
    {q6("case when status = 'matched' then least(greatest(0.33::double * (1 - js) + 0.33::double * iou + 0.34::double * coalesce(jit, 0.0::double), 0.0::double), 1.0::double) end")} as stability
from m1 left join k on k.box_id = m1.box_id_t""")
def jitter_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = scoring.score(*jittered_matches(spark, sf, 1))
    return s.select("box_id_t", "jitter_executed", r6(F.col("c_jitter_loc")).alias("c_jitter_loc"), r6(F.col("stability")).alias("stability"))


@query(f"""{M1}, {SCORED} select d.box_id, d.pred_class, {q6("d.confidence")} as confidence, d.x1, d.y2, status, case when status = 'matched' then bp end as matched_prev_id, {q6("s")} as stability, coalesce(s >= 0.6 and d.confidence >= 0.4, false) as admitted
from d1 d join sc1 on sc1.image_id = d.image_id and sc1.box_id_t = d.box_id""")
def bank_store_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = bank_rows(fx.detections(spark, sf, 1), admission.admit(scored(spark, sf, 1), admission.dual_gate()))
    return rows.select("box_id", "pred_class", r6(F.col("confidence")).alias("confidence"), "box.x1", "box.y2", "status", "matched_prev_id", r6(F.col("stability")).alias("stability"), "admitted")


@query(f"""with {o.rounds(0)} select box_id, pred_class, cast(null as double) as stability, false as admitted, cast(null as varchar) as matched_prev_id from d0""")
def bootstrap_store_rows(spark: SparkSession, sf: str) -> DataFrame:
    return bootstrap_rows(fx.detections(spark, sf, 0)).select("box_id", "pred_class", "stability", "admitted", "matched_prev_id")


NAMES_SQL = "names(pred_class, class_name) as (values " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(CLASS_NAMES)) + ")"


@query(f"""{M1}, {SCORED}, a as (select * from sc1 where s >= 0.6 and confidence >= 0.4), {NAMES_SQL}, c as (select pred_class_t, count(*) as n from a group by 1), t as (select count(*) as n_admitted, count(distinct image_id) as images_with_labels, (select count(*) from d1) as n_candidates from a)
select names.pred_class, class_name, coalesce(n, 0) as n, {q6("100.0::double * coalesce(n, 0) / n_admitted")} as pct, n_admitted, images_with_labels, n_candidates, {q6("100.0::double * n_admitted / n_candidates")} as admitted_pct
from names left join c on c.pred_class_t = names.pred_class cross join t""")
def pl_stats(spark: SparkSession, sf: str) -> DataFrame:
    kept = admission.admit(scored(spark, sf, 1), admission.dual_gate()).where("admitted").withColumnRenamed("pred_class_t", "pred_class")
    out = admission.pseudo_label_stats(kept, fx.detections(spark, sf, 1).count(), CLASS_NAMES)
    return out.withColumn("pct", r6(F.col("pct"))).withColumn("admitted_pct", r6(F.col("admitted_pct")))


@query(f"""with {o.rounds(1)}, {NAMES_SQL}, c as (select pred_class, count(*) as det_count, count(*) filter (confidence >= 0.5) as admitted_count, avg(confidence) as ma, avg(confidence) filter (confidence >= 0.5) as mb, median(confidence) as da, median(confidence) filter (confidence >= 0.5) as db from d1 group by 1)
select n.pred_class, class_name, det_count, admitted_count, {q6("100.0::double * det_count / (sum(det_count) over ())::double")} as det_pct, {q6("100.0::double * admitted_count / (sum(admitted_count) over ())::double")} as admitted_pct,
{q6("ma")} as mean_all, {q6("mb")} as mean_admitted, {q6("da")} as median_all, {q6("db")} as median_admitted from names n join c on c.pred_class = n.pred_class""")
def audit_class(spark: SparkSession, sf: str) -> DataFrame:
    a = audit.class_audit(fx.detections(spark, sf, 1), 0.5, CLASS_NAMES)
    return a.select("pred_class", "class_name", "det_count", "admitted_count", *[r6(F.col(c)).alias(c) for c in a.columns[4:]])


@query(f"""with {o.rounds(1)}, {o.IMAGES}, c as (select image_id, count(*) as n_det, count(*) filter (confidence >= 0.5) as n_admitted, max(confidence) as max_conf,
string_agg(cast(pred_class as varchar), ',' order by det_index) filter (confidence >= 0.5) as cl from d1 group by image_id)
select i.image_id, coalesce(n_det, 0) as n_det, coalesce(n_admitted, 0) as n_admitted, {q6("max_conf")} as max_conf, coalesce(cl, '') as admitted_classes from images i left join c on c.image_id = i.image_id""")
def audit_image(spark: SparkSession, sf: str) -> DataFrame:
    a = audit.image_audit(fx.images(spark, sf), fx.detections(spark, sf, 1), 0.5)
    return a.select("image_id", "n_det", "n_admitted", r6(F.col("max_conf")).alias("max_conf"), F.array_join(F.col("admitted_classes").cast("array<string>"), ",").alias("admitted_classes"))


@query(f"""with {o.rounds(1)}, {o.IMAGES}, {NAMES_SQL}, c as (select pred_class, count(*) as n, count(*) filter (confidence >= 0.5) as a from d1 group by 1), p as (select image_id, count(*) filter (confidence >= 0.5) as a from d1 group by 1)
select (select count(*) from images) as n_images, (select count(*) from p) as images_with_any_det, (select count(*) from p where a > 0) as images_with_admitted, (select sum(n)::bigint from c) as total_det, (select sum(a)::bigint from c) as admitted,
(select class_name from names join c on c.pred_class = names.pred_class order by a desc, names.pred_class limit 1) as top_class, {q6("(select 100.0::double * max(a) / sum(a)::double from c)")} as top_class_pct,
{q6("100.0::double * (select count(*) from p where a > 0) / (select count(*) from images)")} as saturation_pct, 100.0::double * (select count(*) from p where a > 0) / (select count(*) from images) > 70 as saturation_flag, (select 100.0::double * max(a) / sum(a)::double from c) > 60 as imbalance_flag""")
def audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.audit_summary(fx.images(spark, sf), fx.detections(spark, sf, 1), 0.5, CLASS_NAMES)
    return out.withColumn("top_class_pct", r6(F.col("top_class_pct"))).withColumn("saturation_pct", r6(F.col("saturation_pct")))


@query(f"""{M1}, {SCORED}, v as (select s, row_number() over (order by s) as k, count(*) over () as n from sc1 where s is not null) select {q6("avg(s)")} as mean_s, count(*) as n_scored, {q6("max(s) filter (k = n // 2 + 1)")} as upper_median_s from v""")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.score_summary(scored(spark, sf, 1))
    return out.select(r6(F.col("mean_s")).alias("mean_s"), "n_scored", r6(F.col("upper_median_s")).alias("upper_median_s"))


ANN = f"with {o.OBJ}, {o.ANNOTATIONS}, {o.IMAGES}, {o.CONVERTED}"


@query(f"""with {o.OBJ}, {o.ANNOTATIONS} select reason, count(*) as n from reasons group by reason""")
def ann_filter(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.reason_counts(fx.annotations(spark, sf))


@query(f"""{ANN} select image_id, class_id, case when bw > 0 and bh > 0 then {q9("(cx1 + cx2) / 2 / width")} end as cx, case when bw > 0 and bh > 0 then {q9("(cy1 + cy2) / 2 / height")} end as cy,
case when bw > 0 and bh > 0 then {q9("bw / width")} end as w, case when bw > 0 and bh > 0 then {q9("bh / height")} end as h, x < 0 or y < 0 or x + w > width or y + h > height as clipped from conv""")
def ann_convert(spark: SparkSession, sf: str) -> DataFrame:
    c = annotations.converted(fx.annotations(spark, sf), fx.images(spark, sf))
    return c.select("image_id", "class_id", *[r9(F.col(f"shape.{n}")).alias(n) for n in ("cx", "cy", "w", "h")], "clipped")


@query(f"""{ANN}, u as (select image_id, position, category_id - 1 as class_id, x, y, w, h from ann where iscrowd = 0 and w > 0 and h > 0),
v as (select image_id, class_id, least(greatest((x + w / 2) / 640, 0.0::double), 1.0::double) as cx, least(greatest((y + h / 2) / 480, 0.0::double), 1.0::double) as cy, least(greatest(w / 640, 0.0::double), 1.0::double) as nw, least(greatest(h / 480, 0.0::double), 1.0::double) as nh from u)
select i.id as image_id, class_id, {q9("cx")} as cx, {q9("cy")} as cy, {q9("nw")} as w, {q9("nh")} as h from images i left join (select * from v where nw > 0 and nh > 0) v on v.image_id = i.id""")
def ann_convert_clamp(spark: SparkSession, sf: str) -> DataFrame:
    c = annotations.converted_clamped(fx.annotations(spark, sf), fx.images(spark, sf), fx.categories(spark))
    return c.select("image_id", "class_id", *[r9(F.col(f"shape.{n}")).alias(n) for n in ("cx", "cy", "w", "h")])


@query(f"""{ANN}, p as (select image_id, count(*) as n, count(*) filter (bw > 0 and bh > 0) as l, count(*) filter (bw > 0 and bh > 0 and (x < 0 or y < 0 or x + w > width or y + h > height)) as c from conv group by image_id)
select count(*) filter (l > 0) as label_files_written, sum(l)::bigint as label_lines_written, sum(c)::bigint as labels_clipped, sum(n - l)::bigint as labels_dropped_zero_area, 0::bigint as label_files_skipped_no_dims, count(*) filter (l = 0) as label_files_skipped_no_anns_left from p""")
def ann_stats(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.conversion_stats(fx.annotations(spark, sf), fx.images(spark, sf))


@query("select p_partkey, case p_partkey % 9 + 1 when 2 then 0 when 3 then 1 when 4 then 2 when 6 then 3 when 8 then 4 end as class_id from part")
def class_remap(spark: SparkSession, sf: str) -> DataFrame:
    return fx.read(spark, sf, "part").select("p_partkey", annotations.mapped_class(F.col("p_partkey") % 9 + 1).alias("class_id"))


@query("select id as category_id, cast(row_number() over (order by id) - 1 as integer) as class_id from (select distinct p_partkey * 7 % 90 as id from part)")
def dense_class_id(spark: SparkSession, sf: str) -> DataFrame:
    """Categories with gaps between their ids, made of the parts."""
    return annotations.dense_classes(fx.read(spark, sf, "part").select((F.col("p_partkey") * 7 % 90).alias("id")).distinct())


@query(f"""{ANN}, l as (select image_id, class_id, (cx1 + cx2) / 2 / width as cx, (cy1 + cy2) / 2 / height as cy, bw / width as w, bh / height as h from conv where bw > 0 and bh > 0),
f as (select image_id, class_id, cx, cy, class_id || ' ' || printf('%.6f', cx) || ' ' || printf('%.6f', cy) || ' ' || printf('%.6f', w) || ' ' || printf('%.6f', h) as line from l)
select {o.pad("image_id")} || '.txt' as file_name, string_agg(line, chr(10) order by class_id, cx, cy, line) as body from f group by image_id""")
def label_text(spark: SparkSession, sf: str) -> DataFrame:
    files = annotations.label_files(annotations.converted(fx.annotations(spark, sf), fx.images(spark, sf)))
    return files.select("file_name", F.array_join("lines", "\n").alias("body"))


BROKEN = "(position % 5, image_id % 7)"


def broken_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Label lines of which some lack a token, have an unknown class, or a number out of range."""
    a = fx.annotations(spark, sf)
    good = F.concat_ws(" ", (F.col("category_id") % 5).cast("string"), F.lit("0.5 0.5 0.25 0.25"))
    line = (
        F.when(F.col("image_id") % 7 == 0, F.lit("1 0.5 0.5 0.25"))
        .when(F.col("image_id") % 7 == 1, F.lit("9 0.5 0.5 0.25 0.25"))
        .when(F.col("image_id") % 7 == 2, F.lit("2 1.5 0.5 0.25 0.25"))
        .when(F.col("image_id") % 7 == 3, F.lit("x 0.5 y 0.25 0"))
        .otherwise(good)
    )
    return a.select(F.concat(F.lit("labels/train/"), F.col("image_id").cast("string"), F.lit(".txt")).alias("path"), line.alias("line"))


@query(f"""with {o.OBJ}, {o.ANNOTATIONS} select 'labels/train/' || image_id || '.txt' as path, image_id % 7 in (1, 3) as bad_class, image_id % 7 in (0, 2, 3) as bad_coords, count(*) as n from ann group by 1, 2, 3""")
def label_check(spark: SparkSession, sf: str) -> DataFrame:
    return quality.parsed_lines(broken_lines(spark, sf), [0, 1, 2, 3, 4]).groupBy("path", "bad_class", "bad_coords").agg(F.count("*").alias("n"))


@query(f"""with {o.OBJ}, {o.ANNOTATIONS}, v as (select * from ann where iscrowd = 0 and w > 0 and h > 0), c as (select category_id, count(*) as instances, count(distinct image_id) as images from v group by 1)
select category_id::bigint as category_id, instances, images, floor(instances * 0.1::double)::bigint as expected from c where category_id in (2, 3, 4, 6, 8)""")
def annotation_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([(c,) for c in (2, 3, 4, 6, 8)], "category_id long")
    return annotations.class_counts(fx.annotations(spark, sf), wanted, 0.1)


@query(f"""with {o.OBJ}, {o.ANNOTATIONS}, c as (select category_id, count(*) as instances from ann where iscrowd = 0 and w > 0 and h > 0 group by 1)
select category_id::bigint as category_id, floor(instances * 0.1::double)::bigint as expected from c where category_id in (2, 3, 4, 6, 8) and floor(instances * 0.1::double) < 595""")
def viability(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.not_viable(annotation_class_counts(spark, sf), 595).select("category_id", "expected")


@query(f"""with {o.OBJ}, {o.ANNOTATIONS} select count(distinct image_id) as images from reasons where reason = 'kept'""")
def image_union(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.union_of_images(fx.annotations(spark, sf), [2, 3, 4, 6, 8])


@query("""with n as (select count(*) as total, greatest(1, round_even(count(*) * 0.1, 0))::bigint as k from orders), r as (select o_orderkey as id, row_number() over (order by md5('2042:' || o_orderkey), o_orderkey) as i from orders),
l as (select id, row_number() over (order by md5('2542:' || id), id) as j from r, n where i <= k), m as (select greatest(1, round_even(k * 0.1, 0))::bigint as v from n)
select id, case when j <= v then 'labeled_inner_val' else 'labeled_train' end as part from l, m union all select id, 'unlabeled' from r, n where i > k""")
def split_native(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split(fx.images(spark, sf), 0.1, fold=2, base_seed=42)


@query("""select count(*) filter (o_orderkey % 3 = 0 and o_orderkey % 4 = 0) as overlap, count(*) filter (o_orderkey % 3 <> 0 and o_orderkey % 4 <> 0) as missing, 0::bigint as extra from orders""")
def split_check(spark: SparkSession, sf: str) -> DataFrame:
    ids = fx.images(spark, sf).select("id")
    return splits.split_report(ids.where("id % 3 = 0"), ids.where("id % 4 = 0"), ids)


@query("""with s as (select lpad(o_orderkey::varchar, 12, '0') as s, o_orderkey as id from orders), a as (select s from s where id % 11 = 0), b as (select s from s where id % 13 = 0)
select 'image without label' as "check", 'train' as part, case when (select count(*) from a) = 0 then 'OK' else 'FAIL' end as status, (select count(*) from a) as n_bad, coalesce((select string_agg(s, ',' order by s) from (select s from a order by s limit 5)), '') as sample
union all select 'label without image', 'train', case when (select count(*) from b) = 0 then 'OK' else 'FAIL' end, (select count(*) from b), coalesce((select string_agg(s, ',' order by s) from (select s from b order by s limit 5)), '')""".replace(
    "a as (select s from s where id % 11 = 0), b as (select s from s where id % 13 = 0)", "a as (select s from s where id % 11 = 0 and id % 13 <> 0), b as (select s from s where id % 13 = 0 and id % 11 <> 0)"
))
def pairing_check(spark: SparkSession, sf: str) -> DataFrame:
    i = fx.images(spark, sf)
    imgs = i.where("id % 13 <> 0").select(F.concat(F.lit("images/train/"), "image_id", F.lit(".jpg")).alias("path"))
    labs = i.where("id % 11 <> 0").select(F.concat(F.lit("labels/train/"), "image_id", F.lit(".txt")).alias("path"))
    return quality.pairing(imgs, labs, "train").withColumn("sample", F.array_join("sample", ","))


@query(f"""{ANN}, c as (select class_id, count(*) as n from conv where bw > 0 and bh > 0 group by 1) select k as class_id, coalesce(n, 0) as n from (values (0), (1), (2), (3), (4), (5)) t(k) left join c on c.class_id = k""")
def class_coverage(spark: SparkSession, sf: str) -> DataFrame:
    lines = annotations.converted(fx.annotations(spark, sf), fx.images(spark, sf)).where("shape is not null")
    return quality.instances(lines, [0, 1, 2, 3, 4, 5])


@query("""with s as (select o_orderkey as id from orders), t as (select status, count(*) as n from (
select case when (select count(*) from s where id % 2 = 0 and id % 3 = 0) = 0 then 'OK' else 'FAIL' end as status union all
select case when (select count(*) from s where id % 2 = 0 and id % 5 = 0) = 0 then 'OK' else 'FAIL' end union all
select case when (select count(*) from s where id % 3 = 0 and id % 5 = 0) = 0 then 'OK' else 'FAIL' end union all select 'OK') group by status) select * from t""")
def partition_status(spark: SparkSession, sf: str) -> DataFrame:
    ids = fx.images(spark, sf).select("id")
    a, b, c = (ids.where(f"id % {k} = 0") for k in (2, 3, 5))
    return quality.status_counts(quality.partitions(a, b, c, a.union(b).distinct()))


METHODS = ["gated", "naive", "supervised"]
#: Results made of the line items: a method for each third of the suppliers, a round for each line number.
RESULTS_SQL = """res as (select ['gated', 'naive', 'supervised'][1 + l_suppkey % 3] as method, l_linenumber - 1 as position, l_linenumber as round_id,
    sum(l_quantity) / (100 * count(*)) as map50, sum(l_partkey % 50)::double / (100 * count(*)) as map50_95, count(*) as n_images from lineitem group by all)"""


def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    method = F.get(F.array(*[F.lit(m) for m in METHODS]), F.col("l_suppkey") % 3)
    rows = fx.read(spark, sf, "lineitem").groupBy(method.alias("method"), (F.col("l_linenumber") - 1).alias("position"), F.col("l_linenumber").alias("round_id"))
    share = lambda x: F.sum(x).cast("double") / (100 * F.count("*"))
    rows = rows.agg(share(F.col("l_quantity")).alias("map50"), share(F.col("l_partkey") % 50).alias("map50_95"), F.count("*").alias("n_images"))
    return rows.withColumn("checkpoint", F.concat("method", F.lit(".pt")))


@query(f"""with {RESULTS_SQL} select round_id, """ + ", ".join(f"coalesce(printf('%.4f', max(map50) filter (method = '{m}')), 'N/A') as {m}" for m in METHODS) + " from res group by round_id")
def round_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return results.round_table(eval_rows(spark, sf), methods=METHODS)


@query(f"""with {RESULTS_SQL} select method, round_id, map50, map50_95 from (select *, row_number() over (partition by method order by map50 desc, position) as k from res) where k = 1""")
def best_round(spark: SparkSession, sf: str) -> DataFrame:
    return results.best_rounds(eval_rows(spark, sf))


@query(f"""with {RESULTS_SQL}, b as (select method, max(map50) as m from res group by method) select {q6("avg(m)")} as mean, {q6("stddev_samp(m)")} as std, count(*) as folds from b""")
def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = results.fold_summary(eval_rows(spark, sf).withColumnRenamed("method", "fold"))
    return out.select(r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "folds")


@query(f"""with {o.rounds(0)} select box_id, {q6("x1 * 1.0::double")} as x1, {q6("y1 * 1.0::double + (640 - 480 * 1.0::double) / 2")} as y1, {q6("x2 * 1.0::double")} as x2, {q6("y2 * 1.0::double + (640 - 480 * 1.0::double) / 2")} as y2 from d0""")
def letterbox_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = geo.letterbox(F.col("box"), F.lit(fx.WIDTH), F.lit(fx.HEIGHT), F.lit(640.0))
    return fx.detections(spark, sf, 0).select("box_id", b.alias("b")).select("box_id", *[r6(F.col(f"b.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), m as (select vec_id, e, list_max(e) as hi from v), x as (select vec_id, list_transform(e, lambda x: exp(x - hi)) as p from m)
select vec_id, {q6("list_max(p) / list_sum(p)")} as top, {q6("p[1] / list_sum(p)")} as first, cast(list_position(p, list_max(p)) - 1 as integer) as place from x""")
def softmax_vec(spark: SparkSession, sf: str) -> DataFrame:
    p = dist.softmax(F.col("embedding").cast("array<double>"))
    e = fx.read(spark, sf, "embeddings").select("vec_id", p.alias("p"))
    return e.select("vec_id", r6(F.array_max("p")).alias("top"), r6(F.get("p", F.lit(0))).alias("first"), dist.argmax(F.col("p")).alias("place"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), d as (select q.vec_id as query, v.vec_id as nearest, list_distance(q.e, v.e) as distance from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)
select query, nearest, round(distance, 5) as distance from (select *, row_number() over (partition by query order by distance, nearest) as k from d) where k = 1""")
def nearest_vector(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.read(spark, sf, "embeddings").select("vec_id", "embedding")
    return inference.nearest_vectors(v.where("vec_id % 100 = 0"), v).withColumn("distance", F.round("distance", 5))


@query(f"""with {o.rounds(0, 1)}, k as (select image_id, det_index, x1, y1 + 80 as y1, x2, y2 + 80 as y2 from d1), x as (select k.image_id, k.det_index, a.det_index as anchor_id,
sqrt((k.x1 - a.x1) * (k.x1 - a.x1) + (k.y1 - a.y1) * (k.y1 - a.y1) + (k.x2 - a.x2) * (k.x2 - a.x2) + (k.y2 - a.y2) * (k.y2 - a.y2)) as distance from k join d0 a on a.image_id = k.image_id)
select image_id, det_index::bigint as det_index, anchor_id::bigint as anchor_id, {q6("distance")} as distance from (select *, row_number() over (partition by image_id, det_index order by distance, anchor_id) as r from x) where r = 1""")
def nearest_anchor(spark: SparkSession, sf: str) -> DataFrame:
    kept = fx.detections(spark, sf, 1).select("image_id", "det_index", "box", F.lit(fx.WIDTH).alias("width"), F.lit(fx.HEIGHT).alias("height"))
    anchors = fx.detections(spark, sf, 0).select("image_id", F.col("det_index").alias("anchor_id"), F.col("box").alias("anchor_box"), "class_scores")
    return inference.nearest_anchors(kept, anchors).select("image_id", F.col("det_index").cast("long").alias("det_index"), F.col("anchor_id").cast("long").alias("anchor_id"), r6(F.col("distance")).alias("distance"))


@query(f"""with {o.rounds(0)} select box_id, {", ".join(f"case when pred_class = {k} then 1.0::double else 0.0::double end as s{k}" for k in range(5))} from d0""")
def onehot(spark: SparkSession, sf: str) -> DataFrame:
    v = dist.onehot(F.col("pred_class"), fx.CLASSES)
    return fx.detections(spark, sf, 0).select("box_id", *[F.get(v, F.lit(k)).alias(f"s{k}") for k in range(5)])


@query(f"""with {o.rounds(0)} select count(*) as n, count(*) filter (list_position(p, list_max(p)) - 1 <> pred_class) as argmax_differs, count(*) filter (abs(list_sum(p) - 1) > 1e-4) as sum_not_one, count(*) filter (abs(list_max(p) - confidence) > 1e-5) as max_not_confidence from d0""")
def argmax_check(spark: SparkSession, sf: str) -> DataFrame:
    return inference.score_report(fx.detections(spark, sf, 0))


@query("""select lpad(o_orderkey::varchar, 12, '0') as image_id, (row_number() over (order by lpad(o_orderkey::varchar, 12, '0')) - 1) // 8 as batch_id, (row_number() over (order by lpad(o_orderkey::varchar, 12, '0')) - 1) % 8 as place from orders""")
def batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    return batches(fx.images(spark, sf).select("image_id"), 8)


@query("""with r as (select lpad(o_orderkey::varchar, 12, '0') as image_id, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders) select image_id from r where i in (select range * (select max(n) from r) // 10 from range(10))""")
def sampled_evenly(spark: SparkSession, sf: str) -> DataFrame:
    return even_sample(fx.images(spark, sf).select("image_id"), 10, "image_id").select("image_id")


@query(f"""{M1}, {o.IMAGES}, c as (select image_id, box_id from d1 where confidence >= 0.1), p as (select image_id, box_id from d0 where confidence >= 0.1)
select * from (select 'image without match' as "check", (select count(*) from images where image_id not in (select image_id from m1)) as n_bad union all
select 'matched box not in current pool', (select count(*) from m1 where status = 'matched' and box_id_t not in (select box_id from c)) union all
select 'unmatched box not in current pool', (select count(*) from m1 where status = 'unmatched' and box_id_t not in (select box_id from c)) union all
select 'ambiguous box not in current pool', (select count(*) from m1 where status = 'ambiguous' and box_id_t not in (select box_id from c)) union all
select 'matched box not in previous pool', (select count(*) from m1 where status = 'matched' and bp not in (select box_id from p)))""")
def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of whole pools against pools that lack the least confident boxes, and against all images."""
    t, p = pair(spark, sf, 1)
    m = saved(matched(spark, sf, 1))
    report = integrity.match_report(m, t.where("confidence >= 0.1"), p.where("confidence >= 0.1"), m.select("image_id").distinct(), fx.images(spark, sf))
    return report.select("check", "n_bad")


@query(f"""{M1}, {SCORED} select image_id, count(*) as n from sc1 where s >= 0.6 and confidence >= 0.4 group by image_id order by n desc, image_id limit 10""")
def topk_images(spark: SparkSession, sf: str) -> DataFrame:
    kept = admission.admit(scored(spark, sf, 1), admission.dual_gate()).where("admitted")
    return kept.groupBy("image_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "image_id").limit(10)


@query(f"""with {o.rounds(0)} select image_id, count(*) as n, string_agg(box_id, ',' order by box_id) as box_ids from d0 group by image_id union all select {o.pad("o_orderkey")}, 0, '' from orders where {o.pad("o_orderkey")} not in (select image_id from d0)""")
def nested_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = inference.nested_pool(fx.images(spark, sf), fx.detections(spark, sf, 0))
    return pool.select("image_id", F.size("boxes").cast("long").alias("n"), F.array_join(F.transform("boxes", lambda b: b["box_id"]), ",").alias("box_ids"))


@query(f"""with {o.rounds(0, 1)} select t.box_id as box_id_t, p.box_id as box_id_prev, {q6(o.iou("t.", "p."))} as iou from d1 t join d0 p on t.image_id = p.image_id and t.det_index = p.det_index""")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.sql import register

    register(spark)
    t, p = (d.select("image_id", "det_index", F.col("box_id").alias(f"box_id_{n}"), F.col("box").alias(n)) for d, n in zip(pair(spark, sf, 1), ("t", "prev"), strict=True))
    return t.join(p, ["image_id", "det_index"]).select("box_id_t", "box_id_prev", r6(F.expr("box_iou(t, prev)")).alias("iou"))


@query(SQL["assign_pairs"])
def sql_assign(spark: SparkSession, sf: str) -> DataFrame:
    """The assignment called from SQL, by parts that hold whole images."""
    from ..functions.sql import register

    register(spark)
    edges = matching.candidate_edges(*pair(spark, sf, 1), keep_lonely=True)
    return spark.sql(
        """select box_id_t, box_id_prev, round(iou, 6) + 0D as iou, round(js, 6) + 0D as js
        from assign(table(select *, pmod(xxhash64(image_id), 1024) as part from {edges}) partition by part order by (image_id, box_id_t, box_id_prev), 0.05D) where status = 'matched'""",
        edges=edges,
    )


@query(f"""with {o.rounds(0, 1)}, {o.edges(1, 0)} select bt as box_id_t, bp as box_id_prev, {q6("js")} as js from e1""")
def sql_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Gated pairs and their divergence, both by SQL functions."""
    from ..functions.sql import register

    register(spark)
    t, p = pair(spark, sf, 1)
    return spark.sql(
        """select t.box_id as box_id_t, p.box_id as box_id_prev, round(js_divergence(t.class_scores, p.class_scores), 6) + 0D as js
        from {t} t join {p} p on t.image_id = p.image_id and box_iou(t.box, p.box) >= 0.3D""",
        t=t,
        p=p,
    )


def _signals_sql(t: int) -> str:
    drift = DRIFT.format(t=t, r=t - 1).replace("h as", f"h{t} as").replace("hn as", f"hn{t} as").replace("from h)", f"from h{t})")
    return f"""c{t} as ({CHURN.format(t=t, r=t - 1)}), {drift},
v{t} as (select count(*) filter (status = 'matched' and confidence >= 0.4 and least(greatest(0.33::double * (1 - js) + 0.33::double * iou, 0.0::double), 1.0::double) >= 0.6) as n_admitted from m{t}),
g{t}s as (select {t} as round_id, n_t, n_admitted, {q6("(n_new + n_removed + n_class_change + n_geom_change)::double / (n_t + n_prev - n_matched)")} as raw_churn,
    {q6("n_admitted::double / n_t")} as stable_yield, round({o.jsd("a", "b")}, 9) as class_drift from c{t}, v{t}, hn{t})"""


@query(f"""with recursive {o.rounds(0, 1, 2)},
{o.matches(1, 0)},
{o.matches(2, 1)},
{_signals_sql(1)},
{_signals_sql(2)}
select * from g1s union all select * from g2s""")
def round_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of rounds 1 and 2, as rows of the loop's history."""
    from functools import reduce

    from .rounds import round_signals as of_round

    out = []
    for t in (1, 2):
        rows = bank_rows(fx.detections(spark, sf, t), admission.admit(scored(spark, sf, t), admission.dual_gate()))
        row = of_round(rows, fx.detections(spark, sf, t - 1), 0.5, fx.CLASSES)
        out.append(row.select(F.lit(t).alias("round_id"), "n_t", "n_admitted", r6(F.col("raw_churn")).alias("raw_churn"), r6(F.col("stable_yield")).alias("stable_yield"), F.round("class_drift", 9).alias("class_drift")))
    return reduce(DataFrame.unionByName, out)


@query()
def image_jitter_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded noise images under the three transforms: a checksum of each."""
    from functools import reduce

    from ..operators.pixels import transform_images

    base = fx.images(spark, sf).select("image_id", F.lit(16).alias("width"), F.lit(12).alias("height"))
    noise = F.concat(*[F.unhex(F.sha2(F.concat("image_id", F.lit(str(k))), 256)) for k in range(18)])
    images = base.withColumn("pixels", noise)
    parts = [transform_images(images, t).select("image_id", F.lit(t).alias("transform"), F.crc32("pixels").alias("checksum")) for t in jitter.TRANSFORMS]
    return reduce(DataFrame.unionByName, parts)
