"""The general training-data operators against brute force and on odd input."""

import json
import random

import pytest
from pyspark.sql import functions as F

from litspark.functions import ids
from litspark.operators import history, multivalue, nested, snapshot_diff


def _values(spark, cells, packing):
    df = spark.createDataFrame([(i, c, "x") for i, c in enumerate(cells)], "id int, v string, pos string")
    out = {}
    for r in multivalue.unpack(df, "v", packing, ["id"]).collect():
        out.setdefault(r.id, []).append((r.pos, r.val))
    return [[v for _, v in sorted(out.get(i, []))] for i in range(len(cells))]


@pytest.mark.parametrize(
    ("packing", "cell", "want"),
    [
        (multivalue.TRANSGENES, 'CAR (anti-A1; B2, hinge); X', ["CAR (anti-A1; B2, hinge)", "X"]),
        (multivalue.TRANSGENES, '"""short"" R1"; solM1 (aa 1–240)', ['"short" R1', "solM1 (aa 1–240)"]),
        (multivalue.TRANSGENES, '"mini-K7, codon-optimised"\nF1', ["mini-K7, codon-optimised", "F1"]),
        (multivalue.TRANSGENES, "A-7/A-7Rα and P1 + Q", ["A-7/A-7Rα", "P1", "Q"]),
        (multivalue.TRANSGENES, '["A", "B, c", null, ""]', ["A", "B, c"]),
        (multivalue.TRANSGENES, "A (b (c; d); e), F", ["A (b (c; d); e)", "F"]),
        (multivalue.TRANSGENES, "x (a; b", ["x (a", "b"]),
        (multivalue.TRANSGENES, '5" long; B', ['5" long', "B"]),
        (multivalue.TRANSGENES, ";; A ;none; - ;B;", ["A", "B"]),
        (multivalue.TARGETS, "K1 D2 E3", ["K1", "D2", "E3"]),
        (multivalue.TARGETS, "F1/G2 & N3", ["F1", "G2", "N3"]),
        (multivalue.TARGETS, "N/A", []),
        (multivalue.AUTHORS, "Doe, Jane; Roe, R. K.", ["Doe, Jane", "Roe, R. K."]),
        (multivalue.AUTHORS, "Doe J, Roe RK, et al.", ["Doe J", "Roe RK"]),
        (multivalue.AUTHORS, "Jane Doe, Rick Roe, and Max Poe", ["Jane Doe", "Rick Roe", "Max Poe"]),
        (multivalue.AUTHORS, "Doe, Jane", ["Doe, Jane"]),
        (multivalue.AUTHORS, '"Doe, Jane ""Jay""", "Roe, R."', ['Doe, Jane "Jay"', "Roe, R."]),
        (multivalue.AUTHORS, "Doe J, Roe K; Poe M", ["Doe J", "Roe K", "Poe M"]),
        (multivalue.AUTHORS, "  ", []),
    ],
)
def test_packed_values(spark, packing, cell, want):
    assert _values(spark, [cell, None], packing) == [want, []]


def test_packed_values_long_and_empty(spark):
    cell = "; ".join(f'"v{i}, x"' for i in range(1500))
    assert len(_values(spark, [cell], multivalue.TRANSGENES)[0]) == 1500
    assert multivalue.unpack(spark.createDataFrame([], "id int, v string"), "v", multivalue.AUTHORS, ["id"]).count() == 0


def test_nested_records(spark):
    p = {"armsInterventionsModule": {"interventions": [{"name": "A", "otherNames": ["a1", None, "a3"]}, None, {"type": "DRUG"}, {}, "bare"]}, "conditionsModule": {"conditions": "alone"},
         "referencesModule": {"references": {"pmid": 12}}, "contactsLocationsModule": {"locationsList": {"location": [{"facility": "F"}]}}}
    raws = [json.dumps({"protocolSection": p}), "﻿" + json.dumps({"study": {"protocolSection": p}}), json.dumps(json.dumps({"studies": [{"protocolSection": p}]})), json.dumps({"protocolSection": p})[:-9], None, "", "[]", "{}"]
    df = spark.createDataFrame([(i, None if r is None else bytearray(r.encode()), "x") for i, r in enumerate(raws)], "id long, raw binary, val string")
    got = {}
    for r in nested.shred(df, "id", "raw", nested.TRIAL, "t").collect():
        got.setdefault(r.parent_key, set()).add((r.child, r.pos, r.sub_pos, r.val))
    want = {("intervention", 1, 0, "A"), ("intervention", 3, 0, ""), ("intervention", 5, 0, "bare"), ("other_name", 1, 1, "a1"), ("other_name", 1, 3, "a3"), ("condition", 1, 0, "alone"), ("reference", 1, 0, "12"), ("location", 1, 0, "F")}
    assert got == {"0": want, "1": want, "2": want}
    assert nested.shred(df.limit(0), "id", "raw", nested.TRIAL, "t").count() == 0


def test_manifest(spark):
    m = {"run": {"queries": [{"query_id": "q", "retries": [{"status": 500}, None, {"status": 503}]}, None, {"query_id": "r", "retries": {"status": 429}}]}}
    df = spark.createDataFrame([("d", json.dumps(m))], "k string, m string")
    got = {(r.child, r.pos, r.sub_pos, r.val) for r in nested.shred(df, "k", "m", nested.MANIFEST, "s").collect()}
    assert got == {("query", 1, 0, "q"), ("query", 3, 0, "r"), ("retry", 1, 1, "500"), ("retry", 1, 3, "503"), ("retry", 3, 1, "429")}


def _diff(spark, rows, dates, bucket_rows=3):
    df = spark.createDataFrame(rows, "k string, d string, h string, t long, r string")
    snaps = spark.createDataFrame([(d,) for d in dates], "snapshot_date string")
    out = snapshot_diff.snapshot_changes(df, snaps, F.col("k"), F.col("d"), F.col("h"), F.col("t"), bucket_rows)
    return {(r.snapshot_date, r.key, r.change_kind) for r in out.collect()}


def test_snapshot_diff_against_brute_force(spark):
    rnd = random.Random(5)
    dates = ["d1", "d2", "d3", "d4"]
    rows = [(f"k{rnd.randrange(12)}", rnd.choice([*dates, "d0"]), rnd.choice(["x", "y", None]), rnd.randrange(10**6), "r") for _ in range(150)]
    rows += [("hot", rnd.choice(dates), "x", i, "r") for i in range(80)] + [(None, "d1", "x", 1, "r")]
    last = {}
    for k, d, h, t, _ in rows:
        if k is not None and (d, k) not in last or k is not None and last[d, k][0] < t:
            last[d, k] = (t, h)
    want = set()
    for a, b in zip(dates, dates[1:], strict=False):
        old, new = ({k: v[1] for (d, k), v in last.items() if d == x} for x in (a, b))
        want |= {(b, k, "added") for k in new.keys() - old.keys()} | {(b, k, "removed") for k in old.keys() - new.keys()} | {(b, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    assert _diff(spark, rows, dates) == want
    assert _diff(spark, [], dates) == set() and _diff(spark, rows, []) == set()
    assert {x for x in _diff(spark, rows, [*dates, "d9"]) if x[0] == "d9"} == {("d9", k, "removed") for d, k in last if d == "d4"}


def _periods(rows, attrs):
    out = set()
    by = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            by.setdefault(r[0], []).append(r)
    for e, rs in by.items():
        rs.sort(key=lambda r: (r[1], r[2]))
        for i, a in enumerate(attrs):
            runs = []
            for r in rs:
                if not runs or runs[-1][0] != r[3 + i]:
                    runs.append((r[3 + i], r[1]))
            ends = [s for _, s in runs[1:]] + [None]
            out |= {(e, a, v, s, t) for (v, s), t in zip(runs, ends, strict=True)}
    return out


def test_history_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(f"e{rnd.randrange(6)}" if rnd.random() < 0.6 else "hot", f"{rnd.randrange(400):014d}", i, rnd.choice(["a", "b", None]), rnd.choice(["x", "y"]), "z") for i in range(600)]
    rows += rows[:20] + [(None, "1", 1, "a", "x", "z"), ("e1", None, 1, "a", "x", "z")]
    seen = {}
    for r in rows:
        seen.setdefault((r[0], r[1], r[2]), r)
    df = spark.createDataFrame(list(seen.values()), "entity string, seen string, vid long, p string, q string, kind string").repartition(5)
    store = history.delta_store(df, ["p", "q"], every=7)
    assert store.where("kind = 'patch'").count() > 0
    for ordered in (True, False):
        got = {tuple(r) for r in history.validity(store, ["p", "q"], ordered).select("entity", "attr", "val", "valid_from", "valid_to").collect()}
        assert got == _periods(seen.values(), ["p", "q"])
    assert history.validity(history.delta_store(df.limit(0), ["p", "q"]), ["p", "q"]).count() == 0


def _versions(rnd, n, first=0):
    return [(f"e{rnd.randrange(6)}" if rnd.random() < 0.6 else "hot", f"{rnd.randrange(400):014d}", first + i, rnd.choice(["a", "b", None]), rnd.choice(["x", "y"])) for i in range(n)]


def test_stored_history_is_read_back_and_appended_to(spark, tmp_path):
    rnd = random.Random(13)
    attrs, schema = ["p", "q"], "entity string, seen string, vid long, p string, q string"
    old, new = _versions(rnd, 300), [("e9", "00000000000001", 999, "a", "x")] + [v for v in _versions(rnd, 40, 1000) if v[0] in ("hot", "e1")]
    history.delta_store(spark.createDataFrame(old, schema).repartition(3), attrs, 5).write.parquet(f"{tmp_path}/store")
    store = spark.read.parquet(f"{tmp_path}/store")
    assert {tuple(r) for r in history.unfolded(store, attrs).collect()} == set(old)
    more = history.appended(store, spark.createDataFrame(new + old[:7], schema), attrs, 5)
    more.write.parquet(f"{tmp_path}/more")
    again = spark.read.parquet(f"{tmp_path}/more")
    got = {tuple(r) for r in history.validity(again, attrs).select("entity", "attr", "val", "valid_from", "valid_to").collect()}
    assert got == _periods(old + new, attrs)
    for time in ("00000000000000", "00000000000200", "00000000000399"):
        want = {}
        for r in sorted(old + new, key=lambda r: (r[1], r[2])):
            if r[1] <= time:
                want[r[0]] = r[3:]
        assert {r.entity: (r.p, r.q) for r in history.state_at(again, attrs, time).collect()} == want
    assert history.appended(store.limit(0), spark.createDataFrame(new, schema), attrs).where("kind = 'full'").count() > 0
    assert history.state_at(store.limit(0), attrs, "9").count() == 0 and history.appended(store, spark.createDataFrame([], schema), attrs).count() == store.count()


def test_snapshot_diff_with_clashing_hashes(spark):
    rnd = random.Random(6)
    rows = [(f"k{rnd.randrange(20)}", rnd.choice(["d1", "d2", "d3"]), rnd.choice(["x", "y"]), i, "r") for i in range(160)]
    df = spark.createDataFrame(rows, "k string, d string, h string, t long, r string")
    snaps = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "snapshot_date string")
    one = lambda h: {tuple(r) for r in snapshot_diff.snapshot_changes(df, snaps, F.col("k"), F.col("d"), F.col("h"), F.col("t"), 3, h).collect()}
    # a poor hash: the keys' last digit
    assert one(lambda c: F.substring(c, -1, 1).cast("long")) == one(F.xxhash64) != set()


def test_tables_of_nested_records(spark):
    doc = {"id": 7, "a": {"b": "x", "n": None}, "l": [{"k": 1.0, "deep": {"v": True}, "in": ["p", None, {"q": 2}]}, 5, [], {"only": []}]}
    raws = [json.dumps(doc), json.dumps(doc, indent=3), json.dumps(json.dumps(json.dumps(json.dumps(json.dumps(json.dumps(doc)))))), json.dumps(doc) + "x", '{"a": 1,}', '{"a" 1}', "[1, 2", '{"a": tru}', '{"a": 01}', None, "7"]
    df = spark.createDataFrame(list(enumerate(raws)), "i long, raw string")
    rows = nested.tables(df, "i", "raw")
    got = {}
    for r in rows.collect():
        got.setdefault(r.parent_key, {})[r.tbl, tuple(r.place)] = (tuple(r.parent_place), dict(r.members))
    want = {("", ()): ((), {"id": "7", "a.b": "x"}), ("l.*", (1,)): ((), {"k": "1", "deep.v": "true"}), ("l.*.in.*", (1, 1)): ((1,), {"": "p"}), ("l.*.in.*", (1, 3)): ((1,), {"q": "2"}), ("l.*", (2,)): ((), {"": "5"}), ("l.*", (4,)): ((), {})}
    assert got == {"0": want, "1": want, "2": want}
    flat = nested.table_of(rows, "l.*", ["k", "deep.v", "none"]).where("parent_key = '0'").collect()
    assert {(tuple(r.place), r.k, r.deep_v, r.none) for r in flat} == {((1,), "1", "true", None), ((2,), None, None, None), ((4,), None, None, None)}


def test_stream_parser_reads_what_json_reads():
    rnd = random.Random(14)

    def value(depth):
        kind = rnd.randrange(8 if depth else 5)
        return [None, rnd.random() < 0.5, rnd.randrange(-9, 99) / rnd.choice([1, 4]), "".join(rnd.choice('ab"\\\u00e9\U0001f600\n/') for _ in range(rnd.randrange(5))), rnd.randrange(10**6)][kind] if kind < 5 else [value(depth - 1) for _ in range(rnd.randrange(4))] if kind < 6 else {f"m{i}": value(depth - 1) for i in range(rnd.randrange(4))}

    def plain(v, path=(), places=()):
        if isinstance(v, list):
            return [x for i, e in enumerate(v, 1) for x in plain(e, (*path, "*"), (*places, i))]
        if isinstance(v, dict):
            return [x for k, e in v.items() for x in plain(e, (*path, k), places)]
        return [(path, places, v)]

    for _ in range(300):
        v = value(4)
        for text in (json.dumps(v), json.dumps(v, indent=1, ensure_ascii=False)):
            assert [(p, o, x) for p, o, x, kind in nested.events(text) if kind != nested.HOLDER] == plain(v)
            broken = text[: rnd.randrange(len(text))] if rnd.random() < 0.5 else text + rnd.choice(["}", "]", " 1", ","])
            try:
                json.loads(broken)
                good = True
            except ValueError:
                good = False
            try:
                list(nested.events(broken))
                mine = True
            except ValueError:
                mine = False
            assert mine == good, broken


def test_wrapped_however_deep():
    p = {"conditionsModule": {"conditions": ["c"]}}
    text = json.dumps({"protocolSection": p})
    for i in range(9):
        text = json.dumps({"study": json.loads(text)}) if i % 2 else json.dumps({"data": [json.loads(text)]})
    assert nested.rows_of(text, nested.TRIAL) == [("condition", 1, 0, "c")]


def test_loose_values(spark):
    df = spark.createDataFrame([("Not yet recruiting", "NOT_YET_RECRUITING"), ("45", "45.0"), (" ", None), ("Acme, Inc.", "ACME  inc")], "a string, b string")
    assert all(r.a == r.b for r in df.select(history.loose(F.col("a")).alias("a"), history.loose(F.col("b")).alias("b")).collect())


def test_ids(spark):
    df = spark.createDataFrame([(" nct 01234567 ", "https://doi.example/10.1234%2FAB.c.", "12 May 2020"), ("NCT123", "NA", "n.d."), (None, None, None)], "n string, d string, y string")
    got = [tuple(r) for r in df.select(ids.nct_id("n"), ids.doi("d"), ids.year("y")).collect()]
    assert got == [("NCT01234567", "10.1234/ab.c", 2020), (None, None, None), (None, None, None)]
