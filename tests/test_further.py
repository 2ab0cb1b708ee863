"""Audits, stickiness, fits, scenarios, resampling and stacked models against plain versions."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import gammas
from ledgerloom.operators import audit as au
from ledgerloom.operators import ensemble as en
from ledgerloom.operators import fits as ft
from ledgerloom.operators import learn as ln
from ledgerloom.operators import resample as rs
from ledgerloom.operators import scenarios as sc
from ledgerloom.operators import stacking as sk

T0 = datetime(2024, 1, 2, 15, 0)


def sides(spark, seed, n=120):
    r = random.Random(seed)
    rows = [[(i, r.choice("AB"), T0 + timedelta(seconds=r.choice([r.uniform(0, 900), 60 * r.randrange(15)])), r.choice([100.0, 101.0, r.uniform(95, 105)])) for i in range(n)] for _ in range(2)]
    return rows, [spark.createDataFrame(x, "id long, account string, ts timestamp, price double") for x in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_the_greedy_walk(spark, seed):
    (left, right), (l, r) = sides(spark, seed)
    pairs = sorted((abs((a[2] - b[2]).total_seconds()), abs(a[3] - b[3]), a[0], b[0]) for a in left for b in right if a[1] == b[1] and abs((a[2] - b[2]).total_seconds()) <= 90 and abs(a[3] - b[3]) <= 2)
    used_l, used_r, want = set(), set(), set()
    for _, _, i, j in pairs:
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            want.add((i, j))
    found = au.candidates(l, r, ["account"])
    assert {(x.l_id, x.r_id) for x in found.collect()} == {p[2:] for p in pairs} and found.count() == len(pairs)
    got = au.one_to_one(found)
    assert {(x.l_id, x.r_id) for x in got.collect()} == want
    rows = au.audit(l, r, got).collect()
    assert len(rows) == len(left) + len(right) and sum(x.match is not None for x in rows) == 2 * len(want)
    assert au.one_to_one(found.limit(0)).collect() == []


def test_steps_by_gap_give_the_greedy_matching(spark, monkeypatch):
    """Many small steps match what all pairs at once do, and never hold as many pairs."""
    _, (l, r) = sides(spark, 5)
    pairs = au.candidates(l, r, ["account"])
    want, held, whole = {(x.l_id, x.r_id, x.gap) for x in au.one_to_one(pairs).collect()}, [], au.one_to_one
    monkeypatch.setattr(au, "one_to_one", lambda near: held.append(near.count()) or whole(near))
    got = au.matched(l, r, ["account"], most=0.5).collect()
    assert {(x.l_id, x.r_id, x.gap) for x in got} == want and len(got) == len(want)
    assert len(held) > 1 and max(held) < pairs.count() / 2


def test_trades_match_at_entry_and_exit(spark):
    schema = "id long, side string, ts timestamp, price double, out_ts timestamp, out_price double"
    row = lambda i, off, out_off, p=1.0: (i, "LONG", T0 + timedelta(seconds=off), p, T0 + timedelta(seconds=600 + out_off), 5.0)
    l = spark.createDataFrame([row(1, 0, 0), row(2, 5, 0)], schema)  # noqa: E741
    r = spark.createDataFrame([row(10, 10, 80), row(11, 89, 91), row(12, 20, -85), row(13, 0, 0, 4.0)], schema)
    got = {(x.l_id, x.r_id): x.gap for x in au.candidates(l, r, ["side"], bands=(("ts", "price"), ("out_ts", "out_price"))).collect()}
    assert got == {(1, 10): 90.0, (1, 12): 105.0, (2, 10): 85.0, (2, 12): 100.0}


def test_weak_votes_need_an_unbroken_chain(spark):
    votes = [(0, "c", "A", 0.9), (1, "c", "A", 0.6), (2, "c", "A", 0.55), (3, "c", "A", 0.4), (4, "c", "A", 0.6), (5, "c", "B", 0.9), (6, "c", "A", 0.6), (8, "c", "A", 0.95), (10, "c", "A", 0.6), (0, "d", "A", 0.6), (1, "d", "A", 0.81), (2, "d", "A", 0.7)]
    r = random.Random(1)
    votes += [(f, "e", r.choice("AB"), r.choice([0.4, 0.6, 0.9])) for f in range(60) if r.random() < 0.95]
    want, state = set(), {}
    for f, cell, a, x in sorted(votes):
        held = state.get((f - 1, cell)) == a
        if x + (0.3 if held else 0) > 0.8:
            state[f, cell] = a
            want.add((f, cell, a))
    got = en.sticky_picks(spark.createDataFrame(votes, "fold long, cell string, account_name string, votes double"), ["cell"])
    assert {(r.fold, r.cell, r.account_name) for r in got.collect()} == want


def samples(kind, n=4000):
    r = np.random.default_rng(5)
    if kind == "student":
        return 2 + 3 * r.standard_t(4, n)
    if kind == "skewed":
        return 1 + 2 * (0.95 * np.abs(r.standard_normal(n)) + math.sqrt(1 - 0.95**2) * r.standard_normal(n))
    return r.normal(-1, 2, n)


def log_likelihood(model, x, location, scale, shape):
    z = (x - location) / scale
    if model == "student":
        return float(np.sum(math.lgamma((shape + 1) / 2) - math.lgamma(shape / 2) - 0.5 * math.log(shape * math.pi) - math.log(scale) - (shape + 1) / 2 * np.log1p(z * z / shape)))
    half = np.array([0.5 * math.erfc(-shape * v / math.sqrt(2)) for v in z])
    return float(np.sum(math.log(2) - 0.5 * math.log(2 * math.pi) - math.log(scale) - z * z / 2 + np.log(half)))


def test_fits_are_likeliest_and_found_by_aic(spark):
    kinds = ("normal", "student", "skewed")
    data = {k: samples(k) for k in kinds}
    df = spark.createDataFrame([(k, float(v)) for k in kinds for v in data[k]] + [("normal", None), ("normal", float("nan")), ("one", 1.0)], "key string, x double")
    fits = ft.best_fits(ft.valued(df, "key", "x")).collect()
    assert {f.key: f.model for f in fits if f.best} == {k: k for k in kinds}
    by = {(f.key, f.model): f for f in fits}
    for model in ("student", "skewed"):
        f, x = by[model, model], data[model]
        here = log_likelihood(model, x, f.location, f.scale, f.shape)
        assert math.isclose(here, f.log_likelihood, abs_tol=0.05)
        for d in (0.98, 1.02):  # no neighbour is likelier by more than what steps are left
            assert log_likelihood(model, x, f.location * d, f.scale, f.shape) < here + 0.05
            assert log_likelihood(model, x, f.location, f.scale * d, f.shape) < here + 0.05
    assert by["student", "student"].shape == 4.0
    assert abs(by["skewed", "skewed"].location - 1) < 0.15 and abs(by["skewed", "skewed"].scale - 2) < 0.15


def test_gammas_and_quantiles(spark):
    xs = [0.3, 1.0, 2.5, 17.0, 1000.5]
    got = [r.g for r in spark.createDataFrame([(x,) for x in xs], "x double").select(gammas.log_gamma(F.col("x")).alias("g")).collect()]
    assert all(math.isclose(g, math.lgamma(x), rel_tol=1e-11, abs_tol=1e-11) for g, x in zip(got, xs, strict=True))
    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.99999]
    zs = [r.z for r in spark.createDataFrame([(p,) for p in ps], "p double").select(F.expr(gammas.normal_quantile_sql("p")).alias("z")).collect()]
    assert all(math.isclose(0.5 * math.erfc(-z / math.sqrt(2)), p, rel_tol=1e-7) for z, p in zip(zs, ps, strict=True))


def test_extreme_values_of_a_known_distribution(spark):
    r = np.random.default_rng(2)
    loss = 10 + 2 / 0.2 * (1 - (-np.log(r.uniform(size=3000))) ** 0.2)  # location 10, scale 2, shape 0.2
    rows = [(i, "A", T0 + timedelta(minutes=i), float(-x)) for i, x in enumerate(loss)]
    got = ft.block_maxima(spark.createDataFrame(rows, "trade_id long, account_name string, entry_time timestamp, profit_loss double"), "account_name", 1).first()
    assert got.blocks == 3000 and abs(got.location - 10) < 0.15 and abs(got.scale - 2) < 0.1 and abs(got.shape - 0.2) < 0.05


def test_scenarios_correlate_as_days_do(spark):
    r = np.random.default_rng(3)
    a = r.standard_normal(300)
    days = {"A": a, "B": 0.8 * a + 0.6 * r.standard_normal(300), "C": r.standard_normal(300)}
    rows = [(k, T0 + timedelta(days=i), float(v)) for k in days for i, v in enumerate(days[k])]
    df = spark.createDataFrame(rows, "account_name string, entry_time timestamp, profit_loss double")
    drawn = {}
    for x in sc.correlated(df, 60, 50).collect():
        drawn.setdefault(x.account_name, {})[x.sim, x.day] = x.pnl
    at = sorted(drawn["A"])
    got, want = (np.corrcoef([[d[k][i] for i in index] for k in "ABC"]) for d, index in ((drawn, at), (days, range(300))))
    assert np.abs(got - want).max() < 0.06
    with pytest.raises(ValueError, match="more than 2"):
        sc.correlated(df, 1, 1, most=2)


def test_repair_makes_a_matrix_positive():
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    good = sc.nearest_positive(bad)
    assert np.linalg.eigvalsh(good)[0] > 0 and np.allclose(np.diag(good), 1) and np.linalg.cholesky(good) is not None
    assert sc.nearest_positive(np.eye(3)) is not None


def test_permuted_places_are_permutations(spark):
    df = spark.range(97).select(F.lit("A").alias("k"), F.col("id").alias("i"), F.lit(97).alias("n")).unionByName(spark.range(96).select(F.lit("B").alias("k"), F.col("id").alias("i"), F.lit(96).alias("n")))
    out = df.withColumn("perm", F.explode(F.array(*[F.lit(p) for p in range(40)]))).withColumn("to", rs.permuted_place(F.col("i"), F.col("n"), 1, F.col("perm"), F.col("k"))).collect()
    seen = {}
    for x in out:
        seen.setdefault((x.k, x.perm), []).append(x.to)
    assert all(sorted(v) == list(range(97 if k == "A" else 96)) for (k, _), v in seen.items())
    assert len({tuple(v) for v in seen.values()}) > 70


def test_poisson_weights(spark):
    w = [r.w for r in spark.range(20_000).select(rs.poisson_weight(sc.uniform(F.col("id"))).alias("w")).collect()]
    n = Counter(w)
    assert abs(sum(w) / len(w) - 1) < 0.03 and abs(n[0] / len(w) - math.exp(-1)) < 0.01 and abs(n[3] / len(w) - math.exp(-1) / 6) < 0.01


def test_luck_keeps_what_an_account_has(spark):
    r = random.Random(8)
    rows = [(i, r.choice("AB"), r.randrange(5), r.gauss(1, 10)) for i in range(700)]
    df = spark.createDataFrame(rows, "trade_id long, account_name string, hour int, profit_loss double")
    found = rs.selected_by_luck(df, "account_name", ["hour"], perms=20, min_trades=1, rate=1.0).collect()
    assert sorted(x.perm for x in found) == list(range(-1, 20))
    cells = Counter((a, h) for _, a, h, _ in rows)
    assert all(0 <= x.n <= 700 and x.cells <= len(cells) for x in found) and len({round(x.total, 6) for x in found}) > 10
    with pytest.raises(ValueError, match="more than 4"):
        rs.selected_by_luck(df, "account_name", ["hour"], perms=1, most_cells=4)


def learned_rows(spark, seed=4, later=0.0):
    r = random.Random(seed)
    rows, p, q = [], 0.0, 0.0
    for i in range(600):
        p, q = 0.8 * p - 0.3 * q + r.gauss(0, 1), p
        rows.append((i, "A", T0 + timedelta(hours=i), 9, p + (later if i >= 450 else 0.0)))
    return ln.table(spark.createDataFrame(rows, "trade_id long, account_name string, entry_time timestamp, hour int, profit_loss double"), "account_name")


def test_no_input_knows_the_result(spark):
    """Predictions of a block stay when the results of later blocks change, and inputs do not hold a row's own result."""
    at = {}
    for later in (0.0, 1000.0):
        blocked = sk.in_blocks(learned_rows(spark, later=later), 4)
        at[later] = {x.trade_id: x.linear for x in sk.forward_predictions(blocked, 4, kinds=("linear",)).filter("trade_id < 450").collect()}
    assert at[0.0] and all(math.isclose(at[0.0][i], at[1000.0][i], abs_tol=1e-9) for i in at[0.0])
    scores = {x.model: x for x in sk.stacking_test(learned_rows(spark)).collect()}
    assert set(scores) == {"linear", "forest", "mean", "weighted", "stack"}
    assert 0.8 < scores["linear"].rmse < 1.3  # the noise itself has a sigma of 1
    assert scores["stack"].rmse < scores["forest"].rmse + 0.05


def test_importance_finds_the_inputs_that_matter(spark):
    rows = sk.in_blocks(learned_rows(spark), 2)
    model = sk.pipeline("linear", ln.INPUTS, "profit_loss").fit(rows.filter("block = 0"))
    got = {x.input: x.importance for x in sk.permutation_importance(model, rows.filter("block = 1"), ln.INPUTS, "trade_id").collect()}
    assert set(got) == set(ln.INPUTS) and max(got, key=got.get) == "prev" and abs(got["hour_sin"]) < 1e-6


def test_hours_of_a_book_compose(spark):
    """Closes at flat positions found hour by hour against one walk."""
    from ledgerloom.operators import matching as mc

    r = random.Random(12)
    rows, want, position = [], set(), 0
    for i in range(1500):
        side, n, kind = r.choice(["BUY", "SELL"]), r.randint(1, 3), r.choice(["OPEN", "CLOSE", "close", None])
        rows.append(("A", "NQ", "s", i, T0 + timedelta(minutes=r.choice([0.3, 0.4]) * i), side, n, kind))
    for row in sorted(rows, key=lambda x: (x[4], x[3])):
        if position == 0 and (row[7] or "").upper() == "CLOSE":
            want.add(row[3])
        else:
            position += row[6] if row[5] == "BUY" else -row[6]
    schema = "account string, symbol string, session string, fill_id long, ts timestamp, side string, quantity int, open_close string"
    ghosts = spark.createDataFrame([("A", "NQ", "s")] * 2, "account string, symbol string, session string")
    got = mc.orphaned_closes(spark.createDataFrame(rows, schema).repartition(4), ghosts).collect()
    assert {x.fill_id for x in got} == want and len(got) == len(want) > 5


def test_hours_stay_whole_where_joins_are_broadcast_while_they_run(spark):
    from ledgerloom.operators import matching as mc

    r = random.Random(3)
    rows, want, position = [], set(), {}
    for i in range(4000):
        side, n, kind, book = r.choice(["BUY", "SELL"]), r.randint(1, 3), r.choice(["OPEN", "OPEN", "CLOSE"]), r.choice("ABC")
        rows.append((book, "NQ", "s", i, T0 + timedelta(seconds=9 * i), side, n, kind))
        if position.setdefault(book, 0) == 0 and kind == "CLOSE":
            want.add(i)
        else:
            position[book] += n if side == "BUY" else -n
    schema = "account string, symbol string, session string, fill_id long, ts timestamp, side string, quantity int, open_close string"
    ghosts = spark.createDataFrame([(b, "NQ", "s") for b in "ABC"], "account string, symbol string, session string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "100k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mc.orphaned_closes(spark.createDataFrame(rows, schema).repartition(8), ghosts).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(x.fill_id for x in got) == sorted(want) and len(want) > 5


def test_ghosts_by_message_file_and_order(spark):
    from ledgerloom.operators import fills as fl

    columns = "fill_id long, account string, symbol string, file string, ts timestamp, side string, quantity int, price double, note string, open_close string, message string, order_id string"
    row = lambda i, note="", message=None, file="f", order="o", kind="OPEN", off=60: (i, "A", "NQ", file, T0 + timedelta(seconds=off * i), "BUY", 2, 10.0, note, kind, message, order)
    rows = [row(i, note="n") for i in range(6)] + [row(10), row(11, message="Text: AutoTrader_3"), row(12, message="plain"), row(13, kind="CLOSE")]
    rows += [row(20 + i, file="quiet") for i in range(7)]
    df = fl.classified(spark.createDataFrame(rows, columns), F.lit(600), by=("account", "symbol", "file"), message="message")
    assert {r.fill_id for r in df.filter("is_ghost").collect()} == {10, 12}  # the quiet file has no notes, so no ghosts
    twice = spark.createDataFrame([row(1, off=0.01), row(2, note="n", off=0.01), row(3, order="p", off=0.01)], columns)
    assert {r.fill_id for r in fl.deduplicated(twice, extra=("order_id",)).collect()} == {2, 3}
    both = twice.withColumn("is_ghost", F.col("fill_id") == 1).withColumn("note", F.lit("")).withColumn("order_id", F.lit("o"))
    assert {r.fill_id for r in fl.deduplicated(both, extra=("order_id",)).collect()} == {2}
