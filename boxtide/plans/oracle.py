"""Pieces of DuckDB SQL that derive the same relations as `fixtures` and the operators."""

from __future__ import annotations

K = 5
OBJ = """obj as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as obj from lineitem)"""


def pad(x: str, n: int = 12) -> str:
    return f"case when length(cast({x} as varchar)) >= {n} then cast({x} as varchar) else lpad(cast({x} as varchar), {n}, '0') end"


def det(r: int) -> str:
    """CTE d<r>: detections of round r, sides as columns, scores as a list p."""
    w = [f"(1 + (l_suppkey * {k + 3} + {r}) % 7 + case when pred_class = {k} then 20 else 0 end)::double" for k in range(K)]
    total = " + ".join(w)
    return f"""d{r} as (
    select {pad("l_orderkey")} as image_id, {pad("l_orderkey")} || '_r{r}_' || {pad("obj", 4)} as box_id, obj as det_index,
        x1::double as x1, y1::double as y1, (x1 + 60 + l_quantity)::double as x2, (y1 + 50 + l_quantity)::double as y2,
        pred_class, [{", ".join(f"{x} / ({total})" for x in w)}] as p,
        0.05::double + 0.95::double * ((31 * l_partkey + 17 * l_suppkey + 13 * {r}) % 1000)::double / 1000.0::double as confidence, l_partkey, l_suppkey
    from (select *, 40 * (l_partkey % 12) + (l_suppkey + 3 * {r}) % 9 as x1, 30 * (l_suppkey % 10) + (l_partkey + 5 * {r}) % 7 as y1,
            cast((l_partkey + case when (13 * l_partkey + 11 * {r}) % 17 = 0 then 1 else 0 end) % {K} as integer) as pred_class
        from obj where (7 * l_partkey + 3 * l_suppkey + 5 * {r}) % 10 <> 0))"""


def meet(a: str, b: str) -> str:
    return f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0.0::double) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0.0::double))"


def area(a: str) -> str:
    return f"(greatest({a}x2 - {a}x1, 0.0::double) * greatest({a}y2 - {a}y1, 0.0::double))"


def iou(a: str, b: str) -> str:
    union = f"({area(a)} + {area(b)} - {meet(a, b)})"
    return f"(case when {meet(a, b)} = 0 or {union} <= 0 then 0.0::double else {meet(a, b)} / {union} end)"


def normalize(p: str) -> str:
    s = f"list_sum({p})"
    return f"(case when {s} > 0 then list_transform({p}, lambda x: x / {s}) else list_transform({p}, lambda x: 1.0::double / len({p})) end)"


def jsd(p: str, q: str) -> str:
    """Of normalised lists of K."""
    part = lambda a, m: f"case when {a} > 0 then {a} * ln({a} / ({m})) else 0.0::double end"
    terms = []
    for k in range(1, K + 1):
        a, b = f"{p}[{k}]", f"{q}[{k}]"
        terms += [part(a, f"({a} + {b}) / 2"), part(b, f"({a} + {b}) / 2")]
    return f"least(1.0::double, greatest(0.0::double, least(greatest(({' + '.join(terms)}) / 2, 0.0::double), ln(2.0::double)) / ln(2.0::double)))"


def edges(t: int, r: int, gate: float = 0.3, name: str = "") -> str:
    """CTE e<t>: gated pairs of rounds t and r with iou, js, cost."""
    n = name or f"e{t}"
    return f"""n{t} as (select *, {normalize("p")} as q from d{t}), n{r}p as (select *, {normalize("p")} as q from d{r}),
{n}g as (select t.image_id, t.box_id as bt, p.box_id as bp, t.pred_class as ct, p.pred_class as cp, t.confidence, {iou("t.", "p.")} as iou, t.q as tq, p.q as pq
    from n{t} t join n{r}p p on t.image_id = p.image_id),
{n} as (select *, 1 - iou + js as cost from (select * exclude (tq, pq), {jsd("tq", "pq")} as js from {n}g where iou >= {gate}))"""


def matches(t: int, r: int, epsilon: float = 0.05) -> str:
    """CTE m<t>: a row a current box, by enumeration of all assignments (needs `with recursive`)."""
    return f"""{edges(t, r)},
i{t} as (select *, dense_rank() over (partition by image_id order by bt) as ci, dense_rank() over (partition by image_id order by bp) - 1 as pi from e{t}),
o{t} as (select image_id, ci, pi, cost, bt, bp from i{t} union all select distinct image_id, ci, null::bigint, 0.0::double, null, null from i{t}),
s{t} as (select image_id, max(ci) as n from i{t} group by image_id),
r{t} as (
    select image_id, 0::bigint as ci, 0::bigint as mask, 0 as card, 0.0::double as cost, []::varchar[] as bts, []::varchar[] as bps from s{t}
    union all
    select r.image_id, r.ci + 1, case when o.pi is null then r.mask else r.mask | (1::bigint << o.pi) end, r.card + case when o.pi is null then 0 else 1 end, r.cost + o.cost,
        case when o.pi is null then r.bts else list_append(r.bts, o.bt) end, case when o.pi is null then r.bps else list_append(r.bps, o.bp) end
    from r{t} r join o{t} o on o.image_id = r.image_id and o.ci = r.ci + 1
    where o.pi is null or (r.mask & (1::bigint << o.pi)) = 0),
b{t} as (select image_id, bts, bps from (
    select r.*, row_number() over (partition by r.image_id order by card desc, cost) as k from r{t} r join s{t} s on s.image_id = r.image_id and s.n = r.ci) where k = 1),
a{t} as (select image_id, unnest(bts) as bt, unnest(bps) as bp from b{t}),
g{t} as (select image_id, bt, count(*) as candidates, list_sort(list(cost)) as costs from e{t} group by image_id, bt),
m{t} as (
    select d.image_id, d.box_id as box_id_t, d.pred_class as pred_class_t, d.confidence, coalesce(g.candidates, 0) as candidates,
        case when a.bt is null then 'unmatched' when g.candidates >= 2 and g.costs[2] - g.costs[1] < {epsilon} then 'ambiguous' else 'matched' end as status,
        a.bp, e.iou, e.js, e.cp
    from d{t} d left join a{t} a on a.image_id = d.image_id and a.bt = d.box_id
        left join e{t} e on e.image_id = a.image_id and e.bt = a.bt and e.bp = a.bp
        left join g{t} g on g.image_id = d.image_id and g.bt = d.box_id)"""


def rounds(*numbers: int) -> str:
    return ",\n".join([OBJ, *[det(r) for r in numbers]])


IMAGES = f"""images as (select o_orderkey as id, {pad("o_orderkey")} as image_id, 640 as width, 480 as height from orders)"""
ANNOTATIONS = """ann as (select l_orderkey as image_id, obj as position, cast(l_partkey % 9 + 1 as integer) as category_id, cast(l_suppkey % 29 = 0 as integer) as iscrowd,
    (40 * (l_partkey % 12) + l_suppkey % 9 - 20)::double as x, (30 * (l_suppkey % 10) + l_partkey % 7 - 20)::double as y, (l_quantity - 3)::double as w, (l_quantity - 3)::double as h from obj),
reasons as (select *, case when iscrowd <> 0 then 'iscrowd' when w <= 0 or h <= 0 then 'invalid_bbox' when category_id not in (2, 3, 4, 6, 8) then 'unselected_class' else 'kept' end as reason from ann)"""
CONVERTED = """conv as (select *, cy2 - cy1 as bh, cx2 - cx1 as bw from (
    select r.*, i.width, i.height, case category_id when 2 then 0 when 3 then 1 when 4 then 2 when 6 then 3 when 8 then 4 end as class_id,
        least(greatest(x, 0.0::double), width::double) as cx1, least(greatest(y, 0.0::double), height::double) as cy1,
        least(greatest(x + w, 0.0::double), width::double) as cx2, least(greatest(y + h, 0.0::double), height::double) as cy2
    from reasons r join images i on i.id = r.image_id where reason = 'kept'))"""
