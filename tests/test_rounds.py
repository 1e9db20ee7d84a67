"""Matching, scoring, admission, signals, jitter, the store and the loop."""

import itertools
import math
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxtide.operators import admission, integrity, jitter, matching, scoring, signals
from boxtide.plans.rounds import bank_rows, bootstrap_rows, evaluate_rounds, naive_loop, naive_round, run_loop
from boxtide.schema import BANK_ROW, CLASS_NAMES, DETECTION, AdmissionConfig, LoopConfig, MatchingConfig, ScoringConfig, StoppingConfig
from boxtide.sources.store import RoundStore

K = 80


def onehot(c, k=K):
    return [1.0 if i == c else 0.0 for i in range(k)]


def pool(spark, boxes, r=1):
    """boxes: (image, id, (x1, y1, x2, y2), class, confidence)."""
    rows = [(i, b, r, tuple(map(float, s)), c, onehot(c), float(f)) for i, b, s, c, f in boxes]
    return spark.createDataFrame(rows, DETECTION)


def one(spark, *boxes, r=1):
    return pool(spark, [("i", f"b{r}_{k}", s, c, 0.8) for k, (s, c) in enumerate(boxes)], r)


def statuses(spark, current, previous, gate=0.3, lam=1.0, eps=0.05):
    rows = matching.match(current, previous, MatchingConfig(gate, lam, eps)).collect()
    return {r.box_id_t: (r.status, r.box_id_prev) for r in rows}


A, FAR = (100, 100, 200, 200), (400, 300, 500, 400)


def shift(d, b=A):
    return tuple(x + d for x in b)


def test_empty_sides(spark):
    none = spark.createDataFrame([], DETECTION)
    assert statuses(spark, none, none) == {} and statuses(spark, none, one(spark, (A, 0))) == {}
    assert statuses(spark, one(spark, (A, 0)), none) == {"b1_0": ("unmatched", None)}


@pytest.mark.parametrize(
    ("current", "previous", "options", "expected"),
    [
        ([(A, 0)], [(A, 0)], {}, {0: 0}),
        ([(A, 0), (FAR, 1), ((0, 0, 50, 50), 2)], [(A, 0), (FAR, 1), ((0, 0, 50, 50), 2)], {}, {0: 0, 1: 1, 2: 2}),
        ([((0, 0, 50, 50), 0)], [((200, 200, 300, 300), 0)], {}, {0: None}),
        ([(shift(20), 0)], [(A, 0)], {}, {0: 0}),
        ([(A, 0)], [(shift(5), 0), (FAR, 0)], {}, {0: 0}),
        ([(A, 3)], [(shift(10), 7)], {"lam": 0.0}, {0: 0}),
        ([(A, 3)], [(A, 7), (A, 3)], {}, {0: 1}),
        ([(A, 3)], [(FAR, 3), (shift(10), 7)], {}, {0: 1}),
        ([(A, 3)], [(shift(5), 3), (FAR, 3)], {"gate": 0.5, "eps": 0.1}, {0: 0}),
        ([(A, 0), (shift(2), 0)], [(A, 0)], {}, {0: 0, 1: None}),
    ],
)
def test_matching_cases(spark, current, previous, options, expected):
    got = statuses(spark, one(spark, *current), one(spark, *previous, r=0), **options)
    for k, p in expected.items():
        assert got[f"b1_{k}"] == (("matched", f"b0_{p}") if p is not None else ("unmatched", None))


def test_ambiguous_frees_both(spark):
    assert statuses(spark, one(spark, (A, 0)), one(spark, (A, 0), (A, 0), r=0), gate=0.1, eps=0.5) == {"b1_0": ("ambiguous", None)}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_optimal(n, m, rnd):
    cost = np.array([[rnd.random() if rnd.random() < 0.6 else np.nan for _ in range(m)] for _ in range(n)])
    best = (0, 0.0)
    for k in range(min(n, m), 0, -1):
        sums = [sum(cost[i, j] for i, j in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k)]
        sums = [s for s in sums if not math.isnan(s)]
        if sums:
            best = (k, min(sums))
            break
    got = matching.least_cost_assignment(cost)
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) == best[0]
    assert sum(cost[i, j] for i, j in got) == pytest.approx(best[1])


def test_large_assignment():
    rng = np.random.default_rng(0)
    cost = rng.random((60, 90))
    got = matching.least_cost_assignment(cost)
    assert len(got) == 60 and sum(cost[i, j] for i, j in got) <= cost.min(1).sum() + 5


def test_blocks_are_connected():
    row, col = np.array([0, 0, 1, 2, 3, 4]), np.array([0, 1, 1, 2, 3, 3])
    b = matching.connected_blocks(row, col)
    assert b[0] == b[1] == b[2] and b[4] == b[5] and len({b[0], b[3], b[4]}) == 3
    assert matching.connected_blocks(row[:0], col[:0]).size == 0


@pytest.mark.parametrize("extra", [0, 1])
def test_chains_of_an_image_take_memory_of_their_edges(extra):
    """20,000 boxes in one chain, each near two of the round before, and in chains of forty; a grid would have 4 * 10^8 cells."""
    n, rng = 20_000, np.random.default_rng(extra)
    row = np.repeat(np.arange(n), 2)
    col = row + np.tile([0, 1], n)
    if extra:
        row, col = col, row
    cost = rng.random(2 * n)
    tracemalloc.start()
    begun = time.perf_counter()
    taken = matching.least_cost_edges(row, col, cost)
    assert time.perf_counter() - begun < 20 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert taken.sum() == n == len(set(row[taken])) == len(set(col[taken]))
    # The one that stays free decides all others: the best total by sums from both ends.
    low, high = (cost[0::2], cost[1::2])
    best = (np.r_[0, np.cumsum(low)] + np.r_[np.cumsum(high[::-1])[::-1], 0]).min()
    assert cost[taken].sum() == pytest.approx(best)
    keep = row // 40 == col // 40
    apart = matching.least_cost_edges(row[keep], col[keep], cost[keep])
    assert apart.sum() == n == len(set(row[keep][apart]))


def test_edges_without_a_cost_or_given_twice():
    row, col = np.array([0, 0, 0, 1]), np.array([0, 0, 1, 1])
    assert matching.least_cost_edges(row, col, np.array([0.5, 0.2, np.nan, 0.1])).tolist() == [False, True, False, True]
    assert not matching.least_cost_edges(row, col, np.full(4, np.nan)).any()
    assert matching.least_cost_edges(row[:0], col[:0], np.zeros(0)).size == 0


def test_sql_assignment_equals_the_operator(spark):
    from boxtide.functions.sql import register

    register(spark)
    rng = np.random.default_rng(5)
    boxes = lambda r, n: pool(spark, [(f"i{k % 7}", f"{r}_{k}", (x, y, x + 60, y + 60), int(k % 3), 0.5) for k, (x, y) in enumerate(rng.integers(0, 120, (n, 2)))], r)
    t, p = boxes(1, 90).persist(), boxes(0, 80).persist()
    edges = matching.candidate_edges(t, p, keep_lonely=True).withColumn("another", F.lit(1))
    got = spark.sql("select * from assign(table({edges}) partition by image_id order by (box_id_t, box_id_prev), 0.05D)", edges=edges)
    assert sorted(map(str, got.collect())) == sorted(map(str, matching.match(t, p).collect()))
    assert spark.sql("select * from assign(table({edges}) partition by image_id order by (box_id_t, box_id_prev), 0.05D)", edges=edges.where("false")).count() == 0


def test_every_box_once(spark):
    rng = np.random.default_rng(1)
    boxes = lambda r, n: pool(spark, [(f"i{k % 7}", f"{r}_{k}", (x, y, x + 60, y + 60), int(k % 3), 0.5) for k, (x, y) in enumerate(rng.integers(0, 120, (n, 2)))], r)
    t, p = boxes(1, 90), boxes(0, 80)
    rows = matching.match(t, p).collect()
    assert sorted(r.box_id_t for r in rows) == sorted(r.box_id for r in t.collect())
    used = [r.box_id_prev for r in rows if r.status == "matched"]
    assert len(used) == len(set(used)) and all(r.box_id_prev is None for r in rows if r.status != "matched")


def triple(spark, box_id, a, b, c, image="i"):
    return spark.createDataFrame([(image, box_id, a, b, c)], "image_id string, box_id string, iou_0 double, iou_1 double, iou_2 double")


def test_scores(spark):
    m = matching.match(one(spark, (A, 0)), one(spark, (A, 0), r=0)).persist()
    score = lambda jit=None, cfg=ScoringConfig(): scoring.score(m, jit, cfg).first()
    full = score(triple(spark, "b1_0", 1.0, 1.0, 1.0))
    assert (full.stability, full.c_cls_dist, full.c_loc, full.c_jitter_loc, full.jitter_executed) == (pytest.approx(1.0), 1.0, 1.0, 1.0, True)
    assert score(triple(spark, "b1_0", 0.9, 0.8, 0.7)).c_jitter_loc == pytest.approx(0.9183503419)
    assert score(triple(spark, "b1_0", 0.8, 0.8, 0.8)).c_jitter_loc == pytest.approx(1.0)
    assert score(triple(spark, "b1_0", 0.8, None, 0.8)).jitter_executed is False
    bare = score(cfg=ScoringConfig(0.5, 0.3, 0.2))
    assert (bare.stability, bare.c_jitter_loc, bare.jitter_executed) == (pytest.approx(0.8), 0.0, False)
    assert score(triple(spark, "b1_0", 1.0, 1.0, 1.0), ScoringConfig(0.5, 0.5, 0.5)).stability == 1.0
    lost = scoring.score(matching.match(one(spark, (A, 0)), one(spark, (FAR, 0), r=0))).first()
    assert (lost.stability, lost.c_loc, lost.c_jitter_loc, lost.jitter_executed) == (None, None, None, False)


def test_score_summary_takes_the_upper_median(spark):
    rows = spark.createDataFrame([(0.1,), (0.2,), (0.6,), (0.9,), (None,)], "stability double")
    assert tuple(scoring.score_summary(rows).first()) == (pytest.approx(0.45), 4, 0.6)
    assert scoring.score_summary(rows.where("stability is null")).first().upper_median_s is None


def test_admission(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("a", 0.6, 0.4), ("b", None, 0.9), ("c", nan, 0.9), ("d", 0.9, nan), ("e", 0.59, 0.9)], "box_id string, stability double, confidence double")
    keep = lambda p: [r.box_id for r in rows.where(p(rows)).collect()]
    assert keep(admission.dual_gate()) == ["a"] and keep(admission.dual_gate(AdmissionConfig(0, 0))) == ["a", "e"]
    assert keep(admission.confidence_gate(0.9)) == ["b", "c", "e"]


def churn(spark, current, previous):
    m = matching.match(current, previous, MatchingConfig(0.1, 1.0, 0.001))
    return signals.churn_parts(m, previous.agg(F.count("*").alias("n_prev")), 0.5).first()


def test_churn(spark):
    none = spark.createDataFrame([], DETECTION)
    assert churn(spark, one(spark, (A, 0), (FAR, 1)), one(spark, (A, 0), r=0)).raw_churn == 0.5
    assert churn(spark, one(spark, (A, 0)), one(spark, (A, 0), (FAR, 1), r=0)).raw_churn == 0.5
    twins = churn(spark, one(spark, (A, 0)), one(spark, (A, 0), (A, 0), r=0))
    assert (twins.n_new, twins.n_removed, twins.n_ambiguous) == (0, 2, 1)
    assert churn(spark, one(spark, (A, 1)), one(spark, (A, 0), r=0)).raw_churn == 1.0
    assert churn(spark, one(spark, (shift(40), 0)), one(spark, (A, 0), r=0)).raw_churn == 1.0
    assert churn(spark, none, none).raw_churn == 0.0


def test_yield_and_drift(spark):
    rows = spark.createDataFrame([(k < 6,) for k in range(10)], "admitted boolean")
    assert signals.stable_yield(rows).first().stable_yield == 0.6 and signals.stable_yield(rows.where("false")).first().stable_yield == 0.0
    t, none = one(spark, (A, 0), (FAR, 1)), spark.createDataFrame([], DETECTION)
    assert signals.class_drift(t, none, K).first()[0] == pytest.approx(0.9152186451)
    assert signals.class_drift(t, t, K).first()[0] == 0.0 and signals.class_drift(none, none, signals.infer_classes(none)).first()[0] == 0.0


PUBLISHED = [(1, 0.0293, 0.2613, 0.0), (2, 0.5968, 0.3642, 0.0013), (3, 0.3972, 0.4094, 0.0013)]


def test_stopping_rules(spark):
    state = signals.StoppingState()
    for row in PUBLISHED:
        state.observe(*row)
    assert (state.consecutive, state.stopped) == (0, False)
    risky = signals.StoppingState(StoppingConfig(tau_risk_churn=0.45)).observe(*PUBLISHED[0]).observe(*PUBLISHED[1])
    assert risky.stopped and risky.reason.startswith("risk_stop")
    loose = signals.StoppingState(StoppingConfig(9, 9, 9, warmup_rounds=0))
    assert [loose.observe(r, 0.1, 0.2, 0.0).consecutive for r in (1, 2, 3)] == [0, 1, 2] and loose.reason == "convergence"
    tight = signals.StoppingState(StoppingConfig(1e-9, 9, 9, warmup_rounds=0))
    assert [tight.observe(r, 0.1 * r, 0.2, 0.0).consecutive for r in (1, 2, 3)] == [0, 0, 0]
    rows = spark.createDataFrame(PUBLISHED + [(4, 0.3973, 0.41, 0.0013), (5, 0.3974, 0.41, 0.0013)], "round_id int, raw_churn double, stable_yield double, class_drift double")
    table = signals.signal_deltas(rows, StoppingConfig(tau_risk_churn=0.45)).orderBy("round_id").collect()
    assert [r.consecutive for r in table] == [0, 0, 0, 1, 2] and [r.stop for r in table] == [False] * 4 + [True] and [r.risk_stop for r in table] == [False, True, False, False, False]


def test_integrity(spark):
    t, p = one(spark, (A, 0), (FAR, 1)), one(spark, (A, 0), r=0)
    m = matching.match(t, p).persist()
    images = t.select("image_id").distinct()
    integrity.require_clean(integrity.match_report(m, t, p, images, images))
    with pytest.raises(ValueError, match="image without match.*lost"):
        integrity.require_clean(integrity.match_report(m, t, p, images, images.union(spark.createDataFrame([("lost",)], "image_id string"))))
    with pytest.raises(ValueError, match="b1_0"):
        integrity.require_clean(integrity.match_report(m, t.where("box_id <> 'b1_0'"), p, images, images))
    with pytest.raises(ValueError, match="previous pool.*b0_0"):
        integrity.require_clean(integrity.match_report(m, t, p.where("false"), images, images))
    with pytest.raises(ValueError, match="more than once.*b1_0"):
        integrity.require_clean(integrity.admitted_report(t.union(t.where("box_id = 'b1_0'")), t))
    with pytest.raises(ValueError, match="not in current pool.*b0_0"):
        integrity.require_clean(integrity.admitted_report(p, t))
    with pytest.raises(ValueError, match="without a score"):
        integrity.require_clean(integrity.unscored_report(t, scoring.score(m).limit(0)))


def test_jitter_triples(spark):
    wanted = spark.createDataFrame([("i", "b", (100.0, 100.0, 200.0, 200.0), 1, 640, 480)], "image_id string, box_id string, box struct<x1:double,y1:double,x2:double,y2:double>, pred_class int, width int, height int")

    def detect(images, transform):
        b = {"scale": (94.0, 96.0, 197.0, 199.0), "translate": (108.0, 108.0, 208.0, 208.0), "brightness": (100.0, 100.0, 200.0, 150.0)}[transform]
        return images.select("image_id", F.struct(*[F.lit(x).alias(n) for x, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)]).alias("box"), F.lit(1).alias("pred_class"))

    row = jitter.jitter_by_detector(wanted, detect, 0.3).first()
    assert row.iou_1 == 1.0 and row.iou_2 == 0.5 and row.iou_0 > 0.9
    assert jitter.jitter_by_detector(wanted, detect, 0.6).count() == 0
    other = lambda images, t: detect(images, t).withColumn("pred_class", F.lit(2))
    assert jitter.jitter_by_detector(wanted, other, 0.3).count() == 0


def meta(r, n=0):
    return {"round_id": r, "n_candidates": n, "n_admitted": 0, "raw_churn": 0.0, "stable_yield": 0.0, "class_drift": 0.0, "stop_condition_met": False, "model_checkpoint": "c"}


def test_store(spark, tmp_path):
    store, path = RoundStore(spark, f"{tmp_path}/s"), f"{tmp_path}/s"
    assert store.committed_rounds() == [] and store.latest_round() is None and store.metadata(3) is None
    with pytest.raises(FileNotFoundError):
        store.pool(0)
    rows = bootstrap_rows(one(spark, (A, 0), (FAR, 1)))
    images = spark.createDataFrame([("i",), ("blank",)], "image_id string")
    store.append(rows.where("false"), images.where("false"), **meta(0))
    store.append(rows, images, **meta(1, 2))
    again = RoundStore(spark, path)
    assert again.pool(0).count() == 0 and again.pool(1).count() == 2 and again.images(1).count() == 2
    assert again.committed_rounds() == [0, 1] and again.latest_round() == 1 and again.metadata(1).n_candidates == 2
    with pytest.raises(FileExistsError):
        again.append(rows, images, **meta(1))
    with pytest.raises(ValueError, match="round"):
        again.append(rows, images, **meta(2))
    back = again.pool(1).orderBy("box_id").first()
    assert back.box.x1 == 100.0 and back.stability is None and back.admitted is False and len(again.pool(1).inputFiles()) == len([f for f in again.pool(1).inputFiles() if "round_id=1/attempt=" in f])
    assert '"box_id":"b1_0"' in again.export_json(1).orderBy("value").first()[0]
    left = again.write(5, rows.withColumn("round_id", F.lit(5)), images)  # a run that ended before its commit
    assert again.committed_rounds() == [0, 1] and again.unfinished() == [(5, left)] and again.drop_unfinished() == []
    again.append(rows.withColumn("round_id", F.lit(5)), images, **meta(5, 2))
    assert again.pool(5).count() == 2 and again.drop_unfinished(0) == [(5, left)] and again.unfinished() == []
    assert again.pool(5).count() == 2 and again.manifests().where("created_at is not null and attempt is not null").count() == 3


def test_one_of_two_commits(spark, tmp_path):
    """Two writers of one round at once: one fails, and nothing that it wrote is read or stays."""
    import threading

    from boxtide.sources.files import put_if_absent

    rows = {k: bootstrap_rows(one(spark, *[(A, 0)] * k)) for k in (1, 2)}
    images = spark.createDataFrame([("i",)], "image_id string")
    for turn in range(3):
        store, gate, out = RoundStore(spark, f"{tmp_path}/race{turn}"), threading.Barrier(2), {}
        commit = store.commit

        def together(attempt, commit=commit, gate=gate, **m):
            gate.wait(60)  # both have written their rows
            commit(attempt, **m)

        store.commit = together

        def writer(k, store=store, out=out):
            try:
                store.append(rows[k], images, **meta(1, k))
                out[k] = "in"
            except FileExistsError:
                out[k] = "late"

        threads = [threading.Thread(target=writer, args=(k,)) for k in rows]
        for x in threads:
            x.start()
        for x in threads:
            x.join(120)
        assert sorted(out.values()) == ["in", "late"]
        won = next(k for k, v in out.items() if v == "in")
        assert store.pool(1).count() == won and store.metadata(1).n_candidates == won and store.unfinished() == []
    done = []

    def put(k):
        try:
            put_if_absent(spark, f"{tmp_path}/puts/one.json", f"text {k}")
            done.append(k)
        except FileExistsError:
            pass

    threads = [threading.Thread(target=put, args=(k,)) for k in range(8)]
    for x in threads:
        x.start()
    for x in threads:
        x.join(60)
    files = [p.name for p in (tmp_path / "puts").iterdir()]
    assert len(done) == 1 and (tmp_path / "puts/one.json").read_text() == f"text {done[0]}" and files == ["one.json"]


def drifting(spark, r):
    rows = [(img, f"{img}_r{r}_{i:04d}", (100 + 200 * i + 2 * r, 100 + 150 * i + 2 * r, 180 + 200 * i + 2 * r, 180 + 150 * i + 2 * r), i, 0.75) for img in "abc" for i in range(2)]
    return spark.createDataFrame([(c,) for c in "abcd"], "image_id string"), pool(spark, rows, r)


def loop_config(**more):
    return LoopConfig(MatchingConfig(0.1, 1.0, 0.001), ScoringConfig(), AdmissionConfig(0, 0), StoppingConfig(1, 1, 1, k_consecutive=99), tau_pre=0.1, max_rounds=2, **more)


def test_loop(spark, tmp_path):
    trained = []
    store = RoundStore(spark, f"{tmp_path}/a")
    out = run_loop(spark, store, loop_config(), lambda c, r: drifting(spark, r), lambda rows, r, c: trained.append((r, rows.count())) or f"ckpt{r}")
    assert out.reason == "max_rounds" and store.committed_rounds() == [0, 1, 2] and trained == [(0, 0), (1, 0)]
    one_, two = store.metadata(1), store.metadata(2)
    assert (one_.raw_churn, one_.stable_yield, one_.n_admitted) == (1.0, 0.0, 0) and one_.class_drift == pytest.approx(0.9152186451)
    assert (two.raw_churn, two.stable_yield, two.class_drift, two.n_admitted) == (0.0, 1.0, 0.0, 6)
    assert {round(r.stability, 10) for r in store.pool(2).collect()} == {0.6289458011}
    assert store.images(2).count() == 4
    assert evaluate_rounds(store, lambda c, r: (c, r), lambda c: c != "ckpt1") == [("ckpt0", 0), ("ckpt0", 1)]


class Ended(Exception):
    pass


@pytest.mark.parametrize("bootstrap", [False, True])
def test_a_loop_ended_at_any_step_goes_on(spark, tmp_path, bootstrap):
    """Whatever call ends it, a resumed loop has the metadata, pools and training of one that ran through."""
    def run(store, fail_at):
        calls = iter(range(10_000))
        log = []

        def step(name, f):
            def call(*a, **k):
                if next(calls) == fail_at:
                    raise Ended(name)
                out = f(*a, **k)
                log.append((name, a[0] if name == "mark" else None))
                return out

            return call

        for name in ("write", "commit", "mark"):
            setattr(store, name, step(name, getattr(RoundStore(store.spark, store.path), name)))
        infer = step("infer", lambda c, r: drifting(spark, r))
        train = step("train", lambda rows, r, c: f"{c}/{r}:{rows.count()}")
        out = run_loop(spark, store, loop_config(bootstrap=bootstrap, train_on_stop=True), infer, train, checkpoint="k", evaluate=step("evaluate", lambda c, r: (c, r)), resume=True)
        return out, log

    whole = RoundStore(spark, f"{tmp_path}/whole")
    want, log = run(whole, -1)
    rows = lambda s: [tuple(r) for r in s.all_metadata().collect()]
    for k in range(1, len(log), 4) if bootstrap else (2,):
        store = RoundStore(spark, f"{tmp_path}/k{k}")
        with pytest.raises(Ended):
            run(store, k)
        got, again = run(RoundStore(spark, store.path), -1)
        assert (got.checkpoint, got.reason, got.state.history, got.state.consecutive) == (want.checkpoint, want.reason, want.state.history, want.state.consecutive)
        assert rows(store) == rows(whole)
        assert len(again) <= len(log) - k + 2 and store.marks() == whole.marks()
        assert store.pool(2).count() == whole.pool(2).count()
        store.drop_unfinished(0)
        assert store.unfinished() == []
    done, log = run(RoundStore(spark, whole.path), -1)
    assert log == [] and done.checkpoint == want.checkpoint and done.state.history == want.state.history
    with pytest.raises(FileExistsError):
        run_loop(spark, RoundStore(spark, whole.path), loop_config(bootstrap=True), lambda c, r: drifting(spark, r), lambda rows, r, c: "k", checkpoint="k")


def test_loop_detects_once_a_round(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def infer(c, r):
        images, boxes = drifting(spark, r)

        def detect(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return images, boxes.mapInArrow(detect, boxes.schema)

    run_loop(spark, RoundStore(spark, f"{tmp_path}/once"), loop_config(), infer, lambda rows, r, c: f"k{r}")
    assert seen.value == 2 * 6


def test_loop_with_jitter_and_bootstrap(spark, tmp_path):
    seen = []

    def steady(images, transform):
        found = drifting(spark, len(seen))[1]
        w, h = F.lit(640), F.lit(640)
        from boxtide.functions.geometry import remap

        return found.join(images.select("image_id"), "image_id").select("image_id", remap(F.col("box"), w, h, transform).alias("box"), "pred_class")

    def infer(c, r):
        if r:
            seen.append(r)
        return drifting(spark, r)

    trained = []
    store = RoundStore(spark, f"{tmp_path}/b")
    out = run_loop(spark, store, loop_config(bootstrap=True, train_on_stop=True), infer, lambda rows, r, c: trained.append((r, rows.count())) or f"k{r}", checkpoint="k0", jitter=steady, evaluate=lambda c, r: (c, r))
    assert trained == [(1, 6), (2, 6)] and out.checkpoint == "k2" and out.evaluations == [("k1", 1), ("k2", 2)]
    row = store.pool(1).first()
    assert row.jitter_executed and row.c_jitter_loc == 1.0 and row.stability == pytest.approx(0.6289458011 + 0.34)
    with pytest.raises(ValueError, match="tau_pre"):
        LoopConfig(tau_pre=0.2)


def test_naive_round(spark):
    d = pool(spark, [("a", "1", A, 0, 0.9), ("a", "2", FAR, 1, 0.2), ("b", "3", A, 1, 0.7)], 4).withColumn("det_index", F.when(F.col("box_id") == "2", 1).otherwise(0))
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    labels, classes, summary = naive_round(d, images, 0.5, CLASS_NAMES, 4)
    assert [r.box_id for r in labels.orderBy("image_id").collect()] == ["a_r4_00000", "b_r4_00001"]
    assert [r.admitted_count for r in classes.orderBy("pred_class").collect()] == [1, 1, 0, 0, 0]
    s = summary.first()
    assert (s.n_images, s.images_with_any_det, s.images_with_admitted, s.top_class, s.top_class_pct, s.saturation_flag, s.imbalance_flag) == (3, 2, 2, "bicycle", 50.0, False, False)


def test_naive_loop(spark, tmp_path):
    seen = []
    store = RoundStore(spark, f"{tmp_path}/naive")

    def infer(checkpoint, t):
        d = pool(spark, [("a", f"1_{t}", A, 0, 0.9), ("a", f"2_{t}", FAR, 1, 0.2 + 0.2 * t)], t)
        return spark.createDataFrame([("a",), ("c",)], "image_id string"), d.withColumn("det_index", F.when(F.col("confidence") == 0.9, 0).otherwise(1))

    last, audits = naive_loop(store, loop_config(), 0.35, CLASS_NAMES, infer, lambda rows, t, c: seen.append((t, rows.count(), c)) or f"k{t}", "k")
    assert last == "k1" and seen == [(0, 1, "k"), (1, 2, "k0")] and store.committed_rounds() == [0, 1]
    assert [a["admitted"] for a in audits] == [1, 2] and [store.metadata(t).n_admitted for t in (0, 1)] == [1, 2]


def test_the_loop_refuses_what_does_not_fit(spark, tmp_path):
    def twice(checkpoint, r):
        images, found = drifting(spark, r)
        return images, found.union(found) if r == 1 else found

    with pytest.raises(ValueError, match="more than once|not in"):
        config = LoopConfig(MatchingConfig(0.1, 1.0, 0.001), ScoringConfig(), AdmissionConfig(0, 0), StoppingConfig(1, 1, 1, k_consecutive=99), tau_pre=0.1, max_rounds=2, bootstrap=True)
        run_loop(spark, RoundStore(spark, f"{tmp_path}/twice"), config, twice, lambda rows, r, c: f"k{r}", checkpoint="k")
    t, p = one(spark, (A, 0)), one(spark, (A, 0), r=0)
    m, images = matching.match(t, p), spark.createDataFrame([("i",)], "image_id string")
    assert scoring.checked_score(m, t, p, images).count() == 1
    for current, previous, pool_images, text in ((t.where("false"), p, images, "not in current"), (t, p.where("false"), images, "not in previous"), (t, p, images.union(spark.createDataFrame([("lost",)], "image_id string")), "without match")):
        with pytest.raises(ValueError, match=text):
            scoring.checked_score(m, current, previous, pool_images)


def test_the_census_of_a_round(spark):
    """Every fault of a round is counted, with the first ids, and a whole round has none; one exchange of boxes."""
    from boxtide.operators import integrity

    t, p = one(spark, (A, 0), (FAR, 1)), one(spark, (A, 0), r=0)
    m = matching.match(t, p)
    done = admission.admit(scoring.score(m), admission.dual_gate(AdmissionConfig(0, 0)))
    report = lambda *x: {r["check"]: (r.n_bad, list(r["sample"])) for r in integrity.round_report(*x).collect() if r.n_bad}
    assert report(m, t, p, done) == {}
    assert report(m, t.where("box_id = 'b1_0'"), p, done) == {"unmatched box not in current pool": (1, ["b1_1"])}
    assert report(m, t, p.where("false"), done) == {"matched box not in previous pool": (1, ["b0_0"])}
    assert report(m, t, p, done.where("box_id_t = 'b1_0'")) == {"box without a score": (1, ["b1_1"])}
    assert report(m, t.union(t), p, done) == {"box more than once in the pool": (2, ["b1_0", "b1_1"])}
    assert report(m, t, p, done.union(done.where("admitted"))) == {"admitted box more than once": (1, ["b1_0"])}
    lost = t.union(t.where("box_id = 'b1_0'").withColumns({"image_id": F.lit("lost"), "box_id": F.lit("b9")}))
    assert report(m, lost, p, done) == {"image without match": (1, ["lost"]), "box without a score": (1, ["b9"])}
    many = spark.range(50).selectExpr("concat('x', lpad(id, 2, '0')) as box_id")
    row = integrity.admitted_report(many.union(many), t).where("n_bad > 0").orderBy("check").collect()
    assert [(r["check"], r.n_bad, list(r["sample"])) for r in row] == [("admitted box more than once", 50, ["x00", "x01", "x02"]), ("admitted box not in current pool", 100, ["x00", "x01", "x02"])]
    plan = integrity.census(integrity._match_members(m, t, p), integrity.MATCH_TAGS, "image_id", "box_id")
    assert plan.count() > 0


def test_medians_by_place_are_true_medians(spark):
    import random
    import statistics

    from boxtide.operators.audit import class_medians

    rng = random.Random(4)
    rows = [(k, rng.randrange(4), rng.choice([0.5, 0.5, round(rng.random(), 2)])) for k in range(501)] + [(900, 7, 0.1), (901, None, 0.5), (902, 1, None)]
    got = {r.pred_class: r for r in class_medians(spark.createDataFrame(rows, "box_id long, pred_class int, confidence double"), 0.5).collect()}
    for c in (0, 1, 2, 3, 7):
        own = [x for _, k, x in rows if k == c and x is not None]
        high = [x for x in own if x >= 0.5]
        assert got[c].median_all == pytest.approx(statistics.median(own)) and got[c].median_admitted == (pytest.approx(statistics.median(high)) if high else None)


def test_values_at_places_without_a_sort(spark):
    """Against sorting: ties, two values, negative and huge ranges, groups of one; few parts ask for many turns."""
    import random

    from boxtide.operators.ordering import values_at

    rng = random.Random(9)
    groups = {1: [rng.random() for _ in range(400)], 2: [0.5] * 300 + [0.25], 3: [7.0], 4: [-1e300, 1e-300, 0.0, -0.5, 1e300], 5: [rng.choice([0.1, 0.1 + 1e-16, 0.2]) for _ in range(99)]}
    rows = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [(None, 1.0), (1, None), (1, float("nan"))], "g long, v double").repartition(5)
    wanted = [(g, k) for g, v in groups.items() for k in {0, len(v) // 3, len(v) // 2, len(v) - 1, len(v)}] + [(9, 0)]
    for parts in (2, 1024):
        found = values_at(rows, "g", "v", spark.createDataFrame(wanted, "g long, place long"), parts)
        assert {(r.g, r.place): r.v for r in found.collect()} == {(g, k): sorted(groups[g])[k] for g, k in wanted if g in groups and k < len(groups[g])}
    assert values_at(rows.limit(0), "g", "v", spark.createDataFrame(wanted, "g long, place long")).count() == 0


def test_bank_rows_fill_gaps(spark):
    d = one(spark, (A, 0), (FAR, 1))
    scored = admission.admit(scoring.score(matching.match(d, one(spark, (A, 0), r=0))), admission.dual_gate()).where("box_id_t = 'b1_0'")
    rows = {r.box_id: r for r in bank_rows(d, scored).collect()}
    assert rows["b1_1"].status is None and rows["b1_1"].admitted is False and rows["b1_0"].admitted is True
    assert set(BANK_ROW.fieldNames()) < set(bank_rows(d, scored).columns)


def test_stream_of_rounds(spark, tmp_path):
    from boxtide.streaming.bank_stream import watch_rounds

    store = RoundStore(spark, f"{tmp_path}/w")
    for r, c, y, d in [(0, 0.0, 0.0, 0.0), *PUBLISHED]:
        store.commit(**(meta(r) | {"raw_churn": c, "stable_yield": y, "class_drift": d}))
    state, q = watch_rounds(spark, f"{tmp_path}/w", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert [h[0] for h in state.history] == [1, 2, 3] and state.consecutive == 0


def test_stopping_stream_keeps_state_over_restarts(spark, tmp_path):
    """Rounds in any order, twice or not whole, in three starts of two loops: the stops are those of the whole history."""
    from boxtide.streaming.stopping_stream import keep_state_in_files, stopping_stream

    keep_state_in_files(spark)
    rng = np.random.default_rng(4)
    history = {k: [(k, r, *map(float, 0.1 + rng.random(3) * (0.03, 0.03, 0.01))) for r in range(1, 13)] for k in ("a", "b")}
    fields = "loop string, round_id int, raw_churn double, stable_yield double, class_drift double"
    config = StoppingConfig(tau_risk_churn=0.115)
    parts = [
        [*history["a"][:4], history["a"][6], (None, 1, 0.1, 0.1, 0.1)],
        [*history["a"][4:9], ("a", 2, 9.0, 9.0, 9.0), ("a", None, 0.1, 0.1, 0.1), ("a", 10, None, 0.1, 0.1), *history["b"][::-1]],
        [*history["a"][::-1], *history["b"]],
    ]
    for rows in parts:
        spark.createDataFrame(rows, fields).withColumn("another", F.lit(1)).write.mode("append").parquet(f"{tmp_path}/in")
        stops = stopping_stream(spark.readStream.schema(f"{fields}, another int").parquet(f"{tmp_path}/in"), config)
        stops.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    for k, rows in history.items():
        whole = signals.signal_deltas(spark.createDataFrame(rows, fields), config)
        assert any(r.stop for r in whole.collect()) and any(r.risk_stop for r in whole.collect())
        columns = ("round_id", "met", "consecutive", "stop", "risk_stop")
        assert got.where(F.col("loop") == k).select(*columns).orderBy("round_id").collect() == whole.select(*columns).orderBy("round_id").collect()
    assert got.where("loop is null").count() == 1


def test_matching_deals_boxes_out_once(spark):
    from boxtide.plans import queries

    plan = queries.matched(spark, "/root/testdata/sf0.001", 1)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan
    assert plan.count("Exchange hashpartitioning(image_id") == plan.count("Exchange hashpartitioning") <= 2


def test_sql_assignment_of_parts_that_hold_many_images(spark, monkeypatch):
    from boxtide.functions.sql import EDGES, Assign

    assert Assign.AT_ONCE == 1 << 14
    edges = spark.range(40).selectExpr("concat('i', id div 2) as image_id", "concat('t', id) as box_id_t", "concat('p', id) as box_id_prev", "0.9D as iou", "0D as js", "1 as pred_class_t", "1 as pred_class_prev", "0.5D as confidence", "0.1D as cost")
    row = edges.select(*EDGES).collect()
    one, parts = Assign(), []
    monkeypatch.setattr(Assign, "AT_ONCE", 7)
    for r in row:
        parts += list(one.eval(r, 0.05))
        assert len(one.rows) <= 8
    parts += list(one.terminate())
    assert [(p[0], p[1], p[2], p[3]) for p in parts] == [(r.image_id, r.box_id_t, r.box_id_prev, "matched") for r in row]


def test_a_census_of_boxes_has_parts_by_their_number(spark):
    from boxtide.operators import integrity

    many = spark.range(0, 200 << 20, 1, 8)
    members = spark.range(5).selectExpr("cast(id as string) as image_id")
    assert integrity._dealt(members, many).rdd.getNumPartitions() == 200


def test_admitted_check_matches_once(spark):
    from boxtide.plans.catalog import QUERIES

    plan = QUERIES["admitted_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # the scored boxes are read from files


def test_class_totals_of_derived_boxes_are_computed_once(spark):
    from boxtide.plans import fixtures

    plan = fixtures.detections(spark, "/root/testdata/sf0.001", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN (pred_class") == fixtures.CLASSES

def test_divergence_beside_the_assignment_equals_the_expression(spark):
    """Odd scores too; and no lambda of the plan is left in what matching does for each box."""
    import pyarrow as pa

    from boxtide.functions import distributions as dist

    nan, inf = float("nan"), float("inf")
    odd = [[0.2, 0.8], [1.0, 0.0], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [-1.0, 3.0], [5.0, 5.0], [], [0.1, 0.2, 0.7]]
    pairs = [(a, b) for a in odd for b in odd if len(a) == len(b)]
    frame = spark.createDataFrame(pairs, "p array<double>, q array<double>").select(dist.js_divergence(F.col("p"), F.col("q")))
    kind = pa.list_(pa.float64())
    got = dist.js_of_scores(pa.array([a for a, _ in pairs], kind).slice(1), pa.array([b for _, b in pairs], kind).slice(1))
    assert got.tolist() == pytest.approx([r[0] for r in frame.collect()][1:], abs=1e-15)
    with pytest.raises(ValueError, match="lengths 2 and 3"):
        dist.js_of_scores(pa.array([[0.5, 0.5]], kind), pa.array([[0.5, 0.2, 0.3]], kind))
    t = one(spark, (A, 0), (FAR, 1))
    m = matching.match(t, one(spark, (A, 0), r=0), keep=["box"])
    assert {r.box_id_t: r.box.x1 for r in m.collect()} == {r.box_id: r.box.x1 for r in t.collect()}
    assert "lambda" not in m._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_in_buckets_move_no_box(spark, tmp_path):
    """Joined with the round before and checked, boxes stay where the store has them; what fails a check is dropped."""
    from boxtide.operators import integrity
    from boxtide.sources.store import by_image, joined_in_buckets, read_buckets, write_buckets

    put = lambda df, name: read_buckets(spark, f"{tmp_path}/it's {name}", df.schema, write_buckets(by_image(df), f"{tmp_path}/it's {name}"))
    t, p = put(one(spark, (A, 0), (FAR, 1)), "t"), put(one(spark, (A, 0), r=0), "p")
    own = put(admission.admit(scoring.score(matching.match(t, p)), admission.dual_gate(AdmissionConfig(0, 0))).withColumnRenamed("box_id_t", "box_id"), "own").withColumnRenamed("box_id", "box_id_t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_in_buckets(spark):
            plans = [frame._jdf.queryExecution().executedPlan().toString() for frame in (matching.match(t, p), integrity.round_report(own, t, p, own))]
        for plan in plans:
            assert "hashpartitioning(image_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert integrity.round_report(own, t, p, own).where("n_bad > 0").count() == 0

    def twice(checkpoint, r):
        images, found = drifting(spark, r)
        return images, found.union(found) if r == 1 else found

    store = RoundStore(spark, f"{tmp_path}/store")
    with pytest.raises(ValueError, match="more than once"):
        run_loop(spark, store, loop_config(bootstrap=True), twice, lambda rows, r, c: f"k{r}", checkpoint="k")
    assert store.committed_rounds() == [0] and store.unfinished() == []
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("buckets_")]


def largest_method(spark, frame):
    """Bytes of bytecode of the largest method that Spark generates for a frame, joins as at size; over 8,000 the JVM never compiles it."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        stages = frame()._jdf.queryExecution().debug().codegenToSeq()
        return max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size()))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_generated_code_of_matching_is_compiled(spark):
    from boxtide.plans import queries

    sf = "/root/testdata/sf0.001"
    t, p = queries.pair(spark, sf, 1)
    assert largest_method(spark, lambda: matching.match(t, p)) < 8000
    assert largest_method(spark, lambda: matching.match(t, p, keep=["box", "class_scores"])) < 8000
    edges = matching.candidate_edges(t, p, keep_lonely=True)
    assert largest_method(spark, lambda: edges) < 8000
    assert "lambda" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_sql_assignment_takes_arrow_batches(spark):
    """Images cut by batches anywhere, and one that goes over many batches, are solved whole; edges are held up to a bound."""
    import pyarrow as pa

    from boxtide.functions.sql import EDGES, AssignBatches, register

    rng = np.random.default_rng(8)
    rows = []
    for i, n in enumerate(rng.integers(1, 7, 60).tolist() + [90]):
        for t in range(n):
            for p in sorted(set(rng.integers(0, n, 3).tolist())) if t % 4 else [None]:
                cost = None if p is None else float(rng.random())
                rows.append((f"i{i:03d}", f"t{t:03d}", None if p is None else f"p{p:03d}", cost and 0.9, cost and 0.1, 1, cost and 2, 0.5, cost))
    rows.insert(0, (None, "t", None, None, None, 1, None, 0.5, None))
    edges = pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), EDGES.values(), strict=True)], names=list(EDGES))
    want = matching.match_images(edges, 0.05).to_pylist()
    for size, at_once in ((1, 1), (3, 5), (7, 1), (64, 10), (10_000, 1 << 14)):
        one, got, held = AssignBatches(), [], 0
        one.AT_ONCE = at_once
        for batch in edges.to_batches(max_chunksize=size):
            for part in one.eval(batch.append_column("more", pa.nulls(batch.num_rows)), pa.array([0.05] * batch.num_rows)):
                got += part.to_pylist()
            held = max(held, one.rows)
        for part in one.terminate():
            got += part.to_pylist()
        assert got == want
        assert held <= at_once + size + 270
    register(spark)
    plan = spark.sql("select * from assign(table({edges}) partition by image_id order by (box_id_t, box_id_prev), 0.05D)", edges=spark.createDataFrame([], matching.candidate_edges(one_box(spark), one_box(spark)).schema))
    assert "ArrowEvalPythonUDTF" in plan._jdf.queryExecution().executedPlan().toString()


def one_box(spark):
    return one(spark, (A, 0))


def test_overlap_of_odd_boxes(spark):
    from boxtide.functions import geometry as geo

    nan, inf = float("nan"), float("inf")
    boxes = [(0, 0, 4, 4), (2, 2, 6, 6), (4, 0, 8, 4), (3, 3, 3, 3), (5, 5, 1, 1), (-0.0, -0.0, 0.0, 0.0), (nan, 0, 4, 4), (0, 0, inf, 4), (-inf, 0, inf, 4), (0, 0, 1e-200, 1e-200), (0, 0, 1e200, 1e200)]

    def plain(a, b):
        if nan in (*a, *b) or any(x != x for x in (*a, *b)):
            return 0.0
        area = lambda r: max(r[2] - r[0], 0.0) * max(r[3] - r[1], 0.0)
        meet = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
        union = area(a) + area(b) - meet
        value = 0.0 if meet == 0 or union <= 0 else meet / union
        return 0.0 if value != value else value

    pairs = [(a, b) for a in boxes for b in boxes]
    kind = "struct<x1: double, y1: double, x2: double, y2: double>"
    frame = spark.createDataFrame([(tuple(map(float, a)), tuple(map(float, b))) for a, b in pairs] + [(None, tuple(map(float, boxes[0])))], f"a {kind}, b {kind}")
    got = [r[0] for r in frame.select(geo.iou(F.col("a"), F.col("b"))).collect()]
    assert got == [plain(a, b) for a, b in pairs] + [None]
    assert not any(str(x) == "-0.0" for x in got)


def test_jitter_moves_nothing_that_lies_by_image(spark):
    from boxtide.plans import queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, triples = queries.jittered_matches(spark, "/root/testdata/sf0.001", 1)
        plan = triples._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(image_id") == 1  # the images' sizes
        assert largest_method(spark, lambda: triples.where("iou_0 >= 0")) < 8000
        assert triples.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_triples_of_odd_boxes(spark):
    box, kind = (100.0, 100.0, 200.0, 200.0), "struct<x1:double,y1:double,x2:double,y2:double>"
    wanted = spark.createDataFrame([("i", "a", box, 1, 640, 480), ("i", "b", box, None, 640, 480), ("i", "c", None, 1, 640, 480), (None, "d", box, 1, 640, 480), ("j", "e", box, 1, 640, 480)], f"image_id string, box_id string, box {kind}, pred_class int, width int, height int")
    moved = {0: (94.0, 96.0, 197.0, 199.0), 1: (108.0, 108.0, 208.0, 208.0), 2: box}
    rows = [("i", k, b, 1) for k, b in moved.items()] + [("i", 2, None, 1), ("i", 2, box, 2), ("i", None, box, 1), ("i", 7, box, 1), (None, 0, box, 1), ("j", 0, moved[0], 1), ("i", 1, box, None)]
    found = spark.createDataFrame(rows, f"image_id string, transform int, box {kind}, pred_class int")
    got = jitter.jitter_triples(wanted, found, 0.3).collect()
    assert [(r.image_id, r.box_id, r.iou_1, r.iou_2) for r in got] == [("i", "a", 1.0, 1.0)]
    assert {r.box_id: (r.iou_1, r.iou_2) for r in jitter.jitter_triples(wanted, found, 0.0).collect()} == {"a": (1.0, 1.0)} | dict.fromkeys("bcde", (0.0, 0.0))


def test_rounds_of_a_loop_number_line_items_once(spark):
    from boxtide.plans import dataset_queries, fixtures

    sf, asked = "/root/testdata/sf0.001", []
    lines = fixtures.saved_objects(spark, sf)
    for r in (0, 1):
        boxes = fixtures.detections(spark, sf, r, lines=lines)
        plan = boxes._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan
        assert sorted(map(str, boxes.collect())) == sorted(map(str, fixtures.detections(spark, sf, r).collect()))
    before = fixtures.objects
    try:
        fixtures.objects = lambda *a: asked.append(a) or before(*a)
        dataset_queries.looped(spark, sf)
    finally:
        fixtures.objects = before
    assert len(asked) == 1
