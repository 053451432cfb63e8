"""The general event operators against plain Python, with dirty rows."""

import datetime as dt
import random
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from questlake.operators import features, id_index, late_events, rolling, sessions
from questlake.functions.scalars import canonical_uuid, event_type_name

T0 = dt.datetime(2024, 3, 1)
LATE = "event_id string, event_type string, event_time timestamp_ntz, player_id bigint, server_id int, tag string, produce_ts timestamp_ntz, sink_ts timestamp_ntz, part string, window_start string"


def late_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        t = T0 + dt.timedelta(seconds=rng.randrange(7200))
        for _ in range(rng.choice((1, 1, 1, 2, 3))):
            sink = t + dt.timedelta(seconds=rng.choice((1, 3, 40, 70, 900, 1790, 1900, 5000)))
            moved = t + dt.timedelta(seconds=rng.choice((0, 0, 65)))
            rows.append([f"e{i}", "login", moved, rng.randrange(20), rng.choice((1, 2, None)), None, t, sink, "clash", "clash"])
    for r in rng.sample(rows, 30):
        r[rng.choice((0, 2, 3, 6, 7))] = None
    return sorted(map(tuple, rows), key=lambda r: (r[7] is None, r[7] or T0))


def late_brute(rows):
    first = {}
    for r in rows:
        if None in (r[0], r[2], r[3], r[6], r[7]):
            continue
        key = (r[7], r[2], r[6], (r[4] is None, r[4] or 0), r[3])
        if r[0] not in first or key < first[r[0]][0]:
            first[r[0]] = (key, r)
    out = defaultdict(lambda: [0, set(), 0, 0])
    for _, r in first.values():
        start = r[2].replace(second=0, microsecond=0)
        if r[7] > start + dt.timedelta(minutes=31):
            continue
        f = out[(r[4], start)]
        f[0] += 1
        f[1].add(r[3])
        f[3 if r[7] > start + dt.timedelta(seconds=65) else 2] += 1
    return {k: (a, len(p), b, c) for k, (a, p, b, c) in out.items()}


@pytest.mark.parametrize("seed,batches,part", [(1, 1, "yyyy-MM-dd"), (2, 5, "yyyy-MM-dd-HH"), (3, 3, "yyyy-MM-dd")])
def test_late_events_equal_brute_force_for_any_batching(spark, tmp_path, seed, batches, part):
    rows = late_rows(seed)
    out = late_events.corrected_figures(spark.createDataFrame(rows, LATE), batches, f"file://{tmp_path}", part=part)
    mine = {(r.server_id, r.window_start): (r.event_cnt, r.player_cnt, r.on_time_event_cnt, r.late_event_cnt) for r in out.collect()}
    assert mine == late_brute(rows)


def test_late_events_replay_and_crash_change_nothing(spark, tmp_path):
    df = spark.createDataFrame(late_rows(4), LATE)
    c = late_events.LateCorrector(spark, f"file://{tmp_path}")
    assert c.apply(df, 0) > 0
    before = sorted(map(tuple, c.figures().collect()), key=str)
    assert c.apply(df, 0) == 0
    publish = c.manifest.publish
    c.manifest.publish = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        c.apply(df.withColumn("event_id", F.concat("event_id", F.lit("x"))), 1)
    assert sorted(map(tuple, c.figures().collect()), key=str) == before
    c.manifest.publish = publish
    assert c.apply(df, 1) == 0 or sorted(map(tuple, c.figures().collect()), key=str) == before


def test_late_events_let_go_of_what_is_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(late_events, "CLOSED", 2)
    rows = [(f"e{h}-{i}", "login", T0 + dt.timedelta(hours=h, minutes=i), i, 1, None, T0, T0 + dt.timedelta(hours=h, minutes=i + 2), "", "") for h in range(5) for i in range(3)]
    c = late_events.LateCorrector(spark, f"file://{tmp_path}")
    for k in range(5):
        c.apply(spark.createDataFrame(rows[3 * k : 3 * k + 3], LATE), k)
    state = c.manifest.load()[1]
    assert len(state["raw"]) <= 3 and state["closed"] and len(state["figures"]) < 5
    assert len(c.files.listdir("novel/batch=0")) == 0 or not c.files.listdir("novel/batch=0/kept=true")
    assert c.figures().count() == 15 and c.figures().agg(F.sum("event_cnt")).first()[0] == 15


def test_late_events_empty(spark):
    assert late_events.corrected_figures(spark.createDataFrame([], LATE)).count() == 0


DAILY = "dt date, server_id int, player_id bigint, recharge_fen bigint, online_sec_sum bigint, last_event_time timestamp_ntz, _d int"


def test_rolling_totals_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for p in (1, 2, 3):
        for d in rng.sample(range(45), 12):
            rows.append((dt.date(2024, 3, 1) + dt.timedelta(d), rng.choice((1, 2)), p, rng.choice((0, 5, 10**12, None)), rng.randrange(100), T0, 1))
    rows += [(rows[0][0], rows[0][1], 1, 77, 5, T0 + dt.timedelta(hours=1), 1), rows[3], (rows[1][0], 1, None, 9, 9, T0, 1), (None, 1, 1, 9, 9, T0, 1)]
    df = spark.createDataFrame(rows, DAILY)
    clean = rolling.latest_versions(df, ["player_id", "server_id", "dt"], "last_event_time", ["recharge_fen", "online_sec_sum"])
    got = {(r.player_id, r.server_id, r.dt): r for r in rolling.rolling_totals(clean, ["player_id", "server_id"], "dt", ["recharge_fen", "online_sec_sum"]).collect()}
    best = {}
    for r in rows:
        if r[2] is None or r[0] is None:
            continue
        for c in (3, 4):
            if r[c] is not None:
                k = (r[2], r[1], r[0], c)
                best[k] = max(best.get(k, (T0 - dt.timedelta(1), 0)), (r[5], r[c]))
    present = {(r[2], r[1], r[0]) for r in rows if r[2] is not None and r[0] is not None}
    days = [min(d for *_, d in present) + dt.timedelta(i) for i in range((max(d for *_, d in present) - min(d for *_, d in present)).days + 1)]
    entities = {(p, s) for p, s, _ in present}
    assert set(got) == {(p, s, d) for p, s in entities for d in days}
    for (p, s, d), r in got.items():
        for n in (7, 30):
            span = [d - dt.timedelta(i) for i in range(n)]
            assert r[f"active_days_{n}d"] == sum((p, s, x) in present for x in span)
            for name, c in (("recharge_fen", 3), ("online_sec_sum", 4)):
                total = sum(best.get((p, s, x, c), (0, 0))[1] for x in span)
                assert r[f"{name}_sum_{n}d"] == total and r[f"{name}_avg_{n}d"] == pytest.approx(total / n)


def test_rolling_totals_empty(spark):
    df = spark.createDataFrame([], DAILY)
    assert rolling.rolling_totals(df, ["player_id"], "dt", ["recharge_fen"]).count() == 0


def test_rolling_bucket_width_does_not_matter(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 1) + dt.timedelta(i), 1, i % 3, i, i, T0, 0) for i in range(60)], DAILY)
    a, b = (sorted(map(tuple, rolling.rolling_totals(df, ["player_id"], "dt", ["recharge_fen"], bucket_days=w).collect())) for w in (None, 4))
    assert a == b and len(a) == 180


def spelled(u, how):
    return [u, u.upper(), u.replace("-", ""), "{" + u + "}", "urn:uuid:" + u, f" {u}\t", "URN:UUID:" + u.upper()][how % 7]


DELIVERY = "event_id string, event_time timestamp_ntz, batch_id bigint, kafka_partition int, kafka_offset bigint, topic string, id string, t int"


@pytest.mark.parametrize("seed,batches,merge_every", [(1, 1, 2), (2, 4, 1), (3, 5, 3)])
def test_id_index_equals_brute_force(spark, tmp_path, seed, batches, merge_every):
    rng = random.Random(seed)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(150)] + [str(uuid.UUID(int=256 * i)) for i in range(5)] + ["not-a-uuid"]
    rows, off = [], Counter()
    for n in range(900):
        u = ids[0] if rng.random() < 0.3 else rng.choice([*ids, None, "", "  "])
        p = rng.randrange(3)
        off[p] += rng.randrange(1, 3)
        rows.append((spelled(u, rng.randrange(7)) if u and len(u) > 30 else u, rng.choice([None, T0, T0 + dt.timedelta(seconds=rng.randrange(50))]), rng.choice((n // 50, n // 50, None)), p, off[p], "clash", "clash", 0))
    index = id_index.build_index({"a": spark.createDataFrame(rows, DELIVERY), "b": spark.createDataFrame(rows[:200], DELIVERY)}, batches, f"file://{tmp_path}", merge_every=merge_every)

    def brute(rows):
        groups = defaultdict(list)
        for r in rows:
            raw = (r[0] or "").strip().lower()
            if raw:
                bare = raw.replace("urn:uuid:", "").translate(str.maketrans("", "", "-{}"))
                groups[bare if len(bare) == 32 else raw].append(((r[1] is None, r[1] or T0, r[2] is None, r[2] or 0, r[3], r[4]), (r[3], r[4])))
        kept = {min(v)[1] for v in groups.values()}
        return {k for v in groups.values() for _, k in v} - kept, kept

    want = {(t, *k) for t, part in (("a", rows), ("b", rows[:200])) for k in brute(part)[0]}
    got = [tuple(r) for r in index.duplicates().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kept = [(r.topic, r.kafka_partition, r.kafka_offset) for r in index.kept().collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {(t, *k) for t, part in (("a", rows), ("b", rows[:200])) for k in brute(part)[1]}


def test_id_index_replay_and_empty(spark, tmp_path):
    empty = id_index.build_index({"a": spark.createDataFrame([], DELIVERY)}, folder=f"file://{tmp_path}/e")
    assert empty.duplicates().count() == 0 and empty.kept().count() == 0
    rows = spark.createDataFrame([(str(uuid.UUID(int=i % 3)), T0, i, 0, i, "", "", 0) for i in range(9)], DELIVERY)
    index = id_index.IdIndex(spark, f"file://{tmp_path}/r", 2)
    batch = index.deliveries(rows, "a")
    index.apply(batch, 0)
    index.apply(batch, 0)
    index.apply(batch, 1)  # the same deliveries once more are no new ones of their own
    assert {r.kafka_offset for r in index.kept().collect()} == {0, 1, 2}
    assert {r.kafka_offset for r in index.duplicates().collect()} == set(range(3, 9))


def test_a_batch_costs_the_same_however_large_the_index(spark, tmp_path):
    """Ten batches: what is shuffled for ten rows doesn't grow, merges stay few, and every run in force is needed."""
    index = id_index.IdIndex(spark, f"file://{tmp_path}", per_cell=500)
    rows = lambda lo, n: spark.range(lo, lo + n).select(F.md5(F.col("id").cast("string")).alias("event_id"), F.lit(T0).cast("timestamp_ntz").alias("event_time"), F.lit(1).alias("batch_id"), F.lit(0).alias("kafka_partition"), F.col("id").alias("kafka_offset"))
    store = spark._jsc.sc().statusStore()

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        gateway = spark.sparkContext._gateway
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    small = []
    for k in range(5):
        index.apply(index.deliveries(rows(k * 4000, 4000), "a"), 2 * k)
        before = shuffled()
        index.apply(index.deliveries(rows(k * 4000, 10), "a"), 2 * k + 1)
        small.append(shuffled() - before)
    assert max(small) < 20_000 and small[-1] < 1.5 * small[0]
    state = index.manifest.load()[1]
    assert sum(r["rows"] for r in state["runs"]) == 20_000 and len(state["runs"]) <= 4
    assert len(index.manifest.folder.listdir("manifest")) <= index.manifest.KEEP
    assert index.kept().count() == 20_000


def test_canonical_uuid(spark):
    u = "0A1b2c3d-0000-4000-8000-00000000000F"
    rows = [(spelled(u, i),) for i in range(7)] + [(None,), ("",), (" \t",), ("xyz",), ("XYZ ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(canonical_uuid(F.col("x"))).collect()]
    assert set(got[:7]) == {u.lower().replace("-", "")} and got[7:10] == [None] * 3 and got[10] == got[11] != None  # noqa: E711


EVENTS = "event_id string, player_id bigint, event_time timestamp_ntz, _u int, session_no int"


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for p in (1, 2, None):
        t = T0
        for i in range(200):
            t += dt.timedelta(microseconds=rng.choice((0, 10**6, 1800 * 10**6, 1800 * 10**6 + 1, 1799 * 10**6, 4000 * 10**6)))
            row = (rng.choice((f"{p}-{i}", f"{p}-{i}", None)), p, rng.choice((t, t, t, None)), 0, 0)
            rows += [row] * rng.choice((1, 1, 2))
    rng.shuffle(rows)
    got = sorted((r.player_id, r.session_no, r.start_us, r.end_us, r.row_cnt, r.event_cnt) for r in sessions.sessions(spark.createDataFrame(rows, EVENTS), event_id="event_id").collect())
    want = []
    for p in (1, 2):
        mine = sorted((r[2], r[0]) for r in rows if r[1] == p and r[2] is not None and r[0] is not None) + [(r[2], None) for r in rows if r[1] == p and r[2] is not None and r[0] is None]
        mine.sort(key=lambda x: x[0])
        parts = []
        for t, e in mine:
            if not parts or t - parts[-1][-1][0] > dt.timedelta(minutes=30):
                parts.append([])
            parts[-1].append((t, e))
        us = lambda t: round((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        for n, part in enumerate(parts, 1):
            ids = [e for _, e in part]
            want.append((p, n, us(part[0][0]), us(part[-1][0]), len(part), len({e for e in ids if e}) + ids.count(None)))
    assert got == sorted(want)


def test_an_identifier_counts_once_a_session_wherever_it_falls(spark):
    """Copies at 00:20 and 00:40 are in one session as much as copies at 00:02 and 00:22; a session later it counts again."""
    at = lambda minute: T0 + dt.timedelta(minutes=minute)
    rows = [("a", 1, at(20)), ("a", 1, at(40)), ("a", 1, at(65)), ("b", 1, at(66)), ("a", 1, at(200)), ("b", 1, at(229)), ("a", 1, at(231)), (None, 1, at(232)), ("c", 2, at(2)), ("c", 2, at(22))]
    got = sessions.sessions(spark.createDataFrame([(*r, 0, 0) for r in rows], EVENTS), event_id="event_id").collect()
    assert sorted((r.player_id, r.session_no, r.row_cnt, r.event_cnt) for r in got) == [(1, 1, 4, 2), (1, 2, 4, 3), (2, 1, 2, 1)]


@pytest.mark.parametrize("seed", [3, 4])
def test_session_identifiers_equal_brute_force_over_many_bins(spark, seed):
    rng = random.Random(seed)
    rows = [(f"e{rng.randrange(25)}" if rng.random() < 0.9 else None, rng.choice((1, 2)), T0 + dt.timedelta(seconds=rng.randrange(0, 86_400 * 2, 60)), 0, 0) for _ in range(300)]
    got = {(r.player_id, r.session_no): r.event_cnt for r in sessions.sessions(spark.createDataFrame(rows, EVENTS), event_id="event_id").collect()}
    want = {}
    for p in (1, 2):
        no, last, seen = 0, None, []
        for t, e in sorted(((r[2], r[0]) for r in rows if r[1] == p), key=lambda x: x[0]):
            if last is None or t - last > dt.timedelta(minutes=30):
                no, seen = no + 1, []
            seen.append(e)
            last = t
            want[(p, no)] = len(set(seen) - {None}) + seen.count(None)
    assert got == want


def test_sessions_empty_and_without_ids(spark):
    assert sessions.sessions(spark.createDataFrame([], EVENTS)).count() == 0
    one = sessions.sessions(spark.createDataFrame([("a", 1, T0, 0, 0)], EVENTS)).collect()
    assert [(r.session_no, r.start_us == r.end_us, r.row_cnt) for r in one] == [(1, True, 1)]


FEATURES = "player_id bigint, event_type string, event_time timestamp_ntz, amount_fen bigint, event_id string, _name string, _i int"


def test_feature_table(spark):
    t = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [
        (1, "Login ", t(1), None, "a", "x", 0), (1, "login", t(5), 7, "b", "x", 0), (1, "login", t(5), 7, "b", "x", 0), (1, "LOG-IN", t(2), 1, None, "x", 0),
        (1, None, None, 3, "c", "x", 0), (2, "pay", t(9), 2**40, "d", "x", 0), (2, "pay", t(8), 1, None, "x", 0), (2, "pay", t(8), 1, None, "x", 0), (None, "login", t(1), 1, "e", "x", 0),
    ]
    df = spark.createDataFrame(rows, FEATURES).withColumn("event_type", event_type_name(F.col("event_type")))
    got = {r.player_id: r.asDict() for r in features.feature_table(df, "player_id", "event_type", "event_time", ["amount_fen"], event_id="event_id").collect()}
    assert set(got) == {1, 2}
    assert (got[1]["login_cnt"], got[1]["login_last"], got[1]["login_amount_fen"]) == (2, t(5), 7)
    assert (got[1]["log_in_cnt"], got[1]["unknown_cnt"], got[1]["unknown_last"], got[1]["unknown_amount_fen"]) == (1, 1, None, 3)
    assert (got[1]["pay_cnt"], got[1]["pay_last"], got[1]["pay_amount_fen"]) == (0, None, None)
    assert (got[2]["pay_cnt"], got[2]["pay_last"], got[2]["pay_amount_fen"]) == (3, t(9), 2**40 + 2)


def test_feature_vectors_merge(spark):
    rows = [(i % 5, f"t{i % 3}", T0 + dt.timedelta(seconds=i), i, None, "", 0) for i in range(60)]
    df = spark.createDataFrame(rows, FEATURES)
    types = features.type_dictionary(df, "event_type")
    make = lambda part: features.type_vectors(spark.createDataFrame(part, FEATURES), types, "player_id", "event_type", "event_time", ["amount_fen"])
    merged = features.expand(features.merge_vectors(make(rows[:31]).unionByName(make(rows[31:]))), types, "player_id", ["amount_fen"])
    whole = features.feature_table(df, "player_id", "event_type", "event_time", ["amount_fen"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_an_event_that_lands_in_two_parts_counts_once(spark, tmp_path):
    when = lambda s: T0 + dt.timedelta(seconds=s)
    first = [(1, "pay", when(1), 5, "a", "x", 0), (1, "pay", when(1), 5, "a", "x", 0), (1, "pay", when(2), 7, None, "x", 0), (2, "login", when(3), None, "b", "x", 0)]
    second = [(1, "pay", when(1), 5, "a", "x", 0), (1, "pay", when(9), 1, "c", "x", 0), (1, "pay", when(4), 2, None, "x", 0), (1, "new", when(8), None, "a", "x", 0), (None, "pay", when(1), 1, "z", "x", 0)]
    store = features.FeatureStore(spark, f"file://{tmp_path}", ["amount_fen"])
    for part, rows in enumerate((first, second, second[:0])):
        for _ in range(2):  # the second time is a replay
            store.add(spark.createDataFrame(rows, FEATURES), part, "player_id", "event_type", "event_time", "event_id")
    assert store.types == ["login", "pay", "new"]  # indices stay, new names go to the end
    got = {(r.player_id, r.event_type): (r.cnt, r.last, r.amount_fen) for r in store.named("player_id").collect()}
    assert got == {(1, "pay"): (4, when(9), 15), (1, "new"): (1, when(8), None), (2, "login"): (1, when(3), None)}
    wide = {r.player_id: r for r in store.table("player_id").collect()}
    assert (wide[1].pay_cnt, wide[1].pay_amount_fen, wide[1].login_cnt, wide[2].login_cnt) == (4, 15, 0, 1)


def test_feature_store_crash_and_empty(spark, tmp_path):
    store = features.FeatureStore(spark, f"file://{tmp_path}", ["amount_fen"])
    assert store.vectors().count() == 0
    df = spark.createDataFrame([(1, "pay", T0, 5, "a", "x", 0)], FEATURES)
    publish, store.manifest.publish = store.manifest.publish, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.add(df, 0, "player_id", "event_type", "event_time", "event_id")
    store.manifest.publish = publish
    assert store.vectors().count() == 0
    store.add(df, 0, "player_id", "event_type", "event_time", "event_id")
    assert [(r.cnt, r.amount_fen) for r in store.named("player_id").collect()] == [(1, 5)]


def test_a_type_that_is_not_in_the_dictionary_is_an_error(spark):
    df = spark.createDataFrame([(1, "pay", T0, 5, "a", "x", 0), (1, "other", T0, 5, "b", "x", 0)], FEATURES)
    with pytest.raises(Exception, match="type not in the dictionary: other"):
        features.feature_table(df, "player_id", "event_type", "event_time", ["amount_fen"], types=["pay"]).collect()


def test_feature_table_empty_and_bounded(spark):
    empty = spark.createDataFrame([], FEATURES)
    out = features.feature_table(empty, "player_id", "event_type", "event_time", [])
    assert out.columns == ["player_id"] and out.count() == 0
    many = spark.createDataFrame([(1, f"t{i}", T0, 1, None, "", 0) for i in range(12)], FEATURES)
    with pytest.raises(features.TooManyTypes):
        features.feature_table(many, "player_id", "event_type", "event_time", [], max_types=10)
