"""Behaviour of the record, resolution, tagging, registry, trial, log and stream operators on small invented frames."""

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litspark.functions import text
from litspark.operators import evaluate, landscape, logs, records, registry, resolve, search, tagging, trials
from litspark.plans.vocabulary import Vocabulary, from_rows
from litspark.sources import files, sinks
from litspark.streaming import logs as streams


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f("v").alias("x")).head().x


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.title_key, "IL-2 <i>in vivo</i>: a T&nbsp;cell", "il2invivoatcell"), (text.title_key, " - ", None), (text.title_key, None, None),
        (text.decode_entities, "a &amp;lt; &#223; &#x41; &unknown;", "a &lt; ß A &unknown;"), (text.html_to_text, "a<br/>b <i>c</i> &amp; d", "a; b c & d"),
        (text.sanitize_html, '<script>x()</script><i onclick="y">a</i> <p>b</p><u>c</u> 1 < 2', "<i>a</i> b c 1 &lt; 2"), (text.sanitize_url, "javascript:alert(1)", None), (text.sanitize_url, "https://a.example/x", "https://a.example/x"),
        (text.strip_invisible, "a​b\x07c\n", "abc\n"), (text.md_escape, "a*b_[c]", r"a\*b\_\[c\]"), (text.slug, "A b/C!", "a-b-c"), (text.human, "ACTIVE_NOT_RECRUITING", "Active not recruiting"), (text.human, "conditionally_replicating", "conditionally replicating"),
        (text.normal_doi, " https://doi.example/10.1/x", "10.1/x"), (text.normal_doi, "doi: 10.1/X", "10.1/X"), (text.normal_authors, " A; B|C ;", "A; B; C"), (text.normal_date, "2020-01-02T03:04", "2020-01-02"), (text.alias_key, "MV-β ®1", "MVΒ1"), (text.alias_key, "kl-7", "KL7"),
    ],
)
def test_text(spark, f, value, want):
    assert _one(spark, value, f) == want


def test_idempotent_sanitiser(spark):
    raw = "<b>x</b> &lt;i&gt;y&lt;/i&gt; <div>z</div> a & b"
    once = _one(spark, raw, text.sanitize_html)
    assert _one(spark, once, text.sanitize_html) == once


def test_dates_and_phases(spark):
    got = [str(_one(spark, v, text.any_date)) for v in ("2020-05", "2020", "05/06/2021", "3 May 2022", "Start: 2020-01-02 | End: x", "n.d.")]
    assert got == ["2020-05-01", "2020-01-01", "2021-05-06", "2022-05-03", "2020-01-02", "None"]
    assert _one(spark, ["PHASE1", "PHASE2", "NA", " "], lambda c: text.phase_label(F.col(c)), "array<string>") == "Phase 1/Phase 2"
    assert _one(spark, ["EARLY_PHASE1"], lambda c: text.phase_label(F.col(c)), "array<string>") == "Early Phase 1"
    assert _one(spark, {"b": [1], "a": [0, 2]}, lambda c: text.inverted_text(F.col(c)), "map<string,array<int>>") == "a b a"


def test_conform_and_union(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "x")], "n int, l array<string>, extra string")
    schema = StructType.fromDDL("l string, n long, missing string")
    assert tuple(records.conform(df, schema).head()) == ("a; b", 1, None)
    u = records.union_sources({"s": spark.createDataFrame([("b",), ("a",)], "k string"), "t": spark.createDataFrame([("c", 1)], "k string, z int")}, "k")
    assert [r.k for r in u.orderBy("row_id").collect()] == ["a", "b", "c"]


def _plain_replay(grp, year, orphan):
    """The title rule as it is stated, row by row."""
    grp = list(grp)
    for i in range(len(grp)):
        if orphan[i]:
            fits = [j for j in range(len(grp)) if j != i and (year[i] is None or year[j] is None or abs(year[j] - year[i]) <= 1)]
            if fits:
                target, mine = grp[min(fits, key=lambda j: (orphan[j], grp[j], j))], grp[i]
                grp = [target if g == mine else g for g in grp]
    return grp


def test_replay_of_title_rule():
    rnd = random.Random(3)
    for _ in range(600):
        n = rnd.randrange(1, 12)
        orphan = [rnd.random() < rnd.choice([0.5, 0.9, 1.0]) for _ in range(n)]
        year = [rnd.choice([None, *range(2015, 2015 + rnd.choice([2, 4, 9]))]) for _ in range(n)]
        grp = [i if o else rnd.randrange(-5, i + 1) for i, o in enumerate(orphan)]
        grp = [g if not orphan[i] and g < 0 else i for i, g in enumerate(grp)]
        anchors = {}
        for g, y, o in zip(grp, year, orphan, strict=True):
            if not o:
                anchors[y] = min(g, anchors.get(y, g))
        rows = [i for i, o in enumerate(orphan) if o]
        want = _plain_replay(grp, year, orphan)
        assert resolve.replay(anchors, rows, [year[i] for i in rows]) == [want[i] for i in rows], (grp, year, orphan)
    assert resolve.replay({2020: 0}, [1, 2], [2021, None]) == [0, 0] and resolve.replay({2018: 0}, [1], [2021]) == [1]
    assert len(set(resolve.replay({}, list(range(20_000)), [2000 + i % 5 for i in range(20_000)]))) == 1


def test_resolution(spark):
    rows = [
        (1, "EPMC", "10.1/A", None, "A title long enough to match", None, "2020-01-01", None), (2, "OpenAlex", "https://doi.org/10.1/a", None, "Other", "the abstract", "2020-02-01", None),
        (3, "CORE", None, None, "A Title Long Enough to Match!", None, "2021", None), (4, "CORE", None, None, "A title long enough to match", None, "2024", None),
        (5, "NIH", None, None, "A title long enough to match", None, "07/15/2020", "g1"), (6, "NIH", None, None, "different", None, None, "g1"), (7, "bioRxiv", "10.9/p", "10.1/A", "pre", None, "2019-01-01", None),
    ]
    df = spark.createDataFrame(rows, "row_id long, source string, doi string, published_doi string, title string, abstract string, publication_date string, grant_id string")
    g = resolve.grouped(df)
    assert {r.row_id: r.grp for r in g.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 1}
    kept = {r.grp: r for r in resolve.kept(resolve.filled(g, ["abstract"]), F.col("row_id").cast("string")).collect()}
    assert kept[1].row_id == 1 and kept[1].abstract == "the abstract" and kept[1].merged_from == "2; 7; 3" and kept[4].merged_from is None
    assert resolve.grouped(df.limit(0)).count() == 0


def test_tagging(spark):
    v = Vocabulary("v", {"T cell": ["T cell", "T cells"], "Regulatory T cell": ["regulatory T cells", "Treg"], "Adenovirus": ["adenovirus", "Ad"], "Gamma": ["γδ thing"]})
    rows = [(1, "Regulatory T cells rule", "T cells"), (2, None, "T cells and T-cells"), (3, "ad hoc Ad", ""), (4, "AN ADENOVIRUS STUDY OF NOTE", None), (5, "HIV-negative adults", None), (6, None, None), (7, "a Γδ thing", "x")]
    df = spark.createDataFrame(rows, "id int, title string, abstract string")
    got = {r.id: (r.primary_x, r.x_hits) for r in tagging.tagged(df, v, "x", "title", "abstract").collect()}
    assert got[1] == ("Regulatory T cell", ["T cell", "Regulatory T cell"]) and got[2] == ("T cell", ["T cell"]) and got[3][0] == "Adenovirus" and got[4][0] == "Adenovirus"
    assert got[5] == (tagging.NONE, []) and got[6] == (tagging.NONE, []) and got[7][0] == "Gamma"
    assert from_rows("w", [("a", "x"), ("a", "y")]).categories == {"a": ["x", "y"]} and v.version != from_rows("w", []).version


def test_search(spark):
    assert search.terms('(gene "viral vector" AND AND, "viral vector" not x) ' + " ".join(map(str, range(12)))) == ["viral vector", "gene", "x", "0", "1", "2", "3", "4"]
    df = spark.createDataFrame([(1, "s", "a viral vector gene", None), (2, "s", "gene", "Viral Vectors"), (3, "t", "oncogene", "viral vector"), (4, "t", None, None)], "id int, source string, title string, abstract string")
    assert {r.id for r in search.matching(df, '"viral vector" gene', ["title", "abstract"]).collect()} == {1, 2}
    page = search.round_robin(df, "source", [F.col("id")], 0, 10)
    assert [r.id for r in page.collect()] == [1, 3, 2, 4] and search.matching(df, "", ["title"]).count() == 0


def test_landscape(spark):
    df = spark.createDataFrame([("clinicaltrials.gov", "Phase 1/Phase 2", "v", "RECRUITING"), ("NIH", None, "v", None), ("medRxiv", None, "w", None), ("EPMC", None, tagging.NONE, None)], "source string, phase string, m string, st string")
    out = landscape.landscape(df.withColumn("stage", landscape.stage(F.col("source"), F.col("phase"))), "m", "stage", F.col("st")).collect()
    assert [(r.therapy, r.trial_phase_2, r.grant, r.preprint, r.recruiting, r.total) for r in out] == [("v", 1, 1, 0, 1, 2), ("w", 0, 0, 1, 0, 1)]


def test_trial_events(spark):
    base = dict(brief_title="t", overall_status="RECRUITING", why_stopped=None, phases=["PHASE1"], has_results=False, enrollment_count="100", enrollment_type="ESTIMATED", completion_date="2024-01", lead_sponsor="A", interventions=[("x", [], "DRUG")])
    new = dict(base, overall_status="TERMINATED", why_stopped="slow", phases=["PHASE2"], has_results=True, enrollment_count="80", completion_date="2024-06", lead_sponsor="B", interventions=[("x", [], "DRUG"), ("y", [], "DRUG")])
    rows = [("n", f"2020010{i}000000", i, tuple(r.get(f.split()[0].strip("`")) for f in _fields())) for i, r in enumerate((base, base, new))]
    df = spark.createDataFrame(rows, f"nct_id string, seen string, vid long, rec struct<{', '.join(_typed())}>").withColumn("rec", trials.canonical(F.col("rec")))
    got = {r.change_type: (r.significance, r.before, r.after) for r in trials.changes(df).collect()}
    assert set(got) == {"status_changed", "phase_changed", "results_posted", "enrollment_changed", "completion_slipped", "sponsor_changed", "intervention_added"}
    assert got["status_changed"] == ("major", "RECRUITING", "TERMINATED (slow)") and got["intervention_added"][2] == '["y"]'


def _fields():
    return ["brief_title", "overall_status", "why_stopped", "phases", "has_results", "enrollment_count", "enrollment_type", "completion_date", "lead_sponsor", "collaborators", "conditions", "interventions", "first_post_date"]


def _typed():
    kinds = {"phases": "array<string>", "has_results": "boolean", "collaborators": "array<string>", "conditions": "array<string>", "interventions": "array<struct<name:string,other_names:array<string>,type:string>>"}
    return [f"{f}:{kinds.get(f, 'string')}" for f in _fields()]


def test_new_and_dropped(spark):
    present = spark.createDataFrame([("2020-01-01", "a"), ("2020-01-08", "b"), ("2020-01-08", "c")], "snapshot_date string, nct_id string")
    snaps = spark.createDataFrame([("2020-01-01", 1), ("2020-01-08", 1)], "snapshot_date string, complete int")
    posted = spark.createDataFrame([("b", "2019-12-20"), ("c", "2018-01-01")], "nct_id string, first_post_date string")
    assert {tuple(r) for r in trials.new_and_dropped(present, snaps, posted).collect()} == {("b", "2020-01-08", "new"), ("a", "2020-01-08", "dropped")}


def test_windows_and_links(spark):
    def keys(t):
        return spark.createDataFrame([(t,)], "t string").select(registry.words_of(F.col("t")).alias("w")).select(registry.window_keys(F.col("w")).alias("k")).head().k

    assert set(keys("MRT 1 1-b")) == {"MRT1", "MRT11", "MRT11B"} and keys("") == [] and len(keys("word " * 3000)) == 8
    names = spark.createDataFrame([("P", "G47∆", "code", 0), ("P", "KLG-706", "code", 0), ("Q", "ON-01", "code", 0)], "axp_id string, alias string, alias_type string, ambiguous int")
    texts = spark.createDataFrame([("a", "G47∆ in glioma"), ("b", "ｋｌｇ－７０６"), ("c", "on 01 January"), ("d", "on-01 again"), ("e", "ON 01"), ("f", None), ("g", "On 01 March")], "id string, text string")
    al = registry.alias_rows(names)
    assert {(r.id, r.axp_id) for r in registry.text_hits(texts, al).collect()} == {("a", "P"), ("b", "P"), *((x, "Q") for x in "cdeg")}
    found = registry.field_hits(texts.withColumnRenamed("text", "title"), al, ["title"])
    assert {(r.id, r.axp_id) for r in found.collect()} == {("a", "P"), ("b", "P"), ("d", "Q"), ("e", "Q")}
    aliases = spark.createDataFrame([("P1", "ABC123", "code", 0), ("P2", "NAMEVEC", "inn", 0), ("P3", "AMBIG", "synonym", 1)], "axp_id string, key string, alias_type string, ambiguous int")
    programs = spark.createDataFrame([("P1", "Acme Pharma Ltd.", None), ("P2", None, None), ("P3", "Candle Therapeutics", None)], "axp_id string, sponsor string, originator string")
    t = spark.createDataFrame([("t1", "a study", "Acme Pharma", [], ["ABC-123"]), ("t2", "Namevec in adults", "X", None, ["placebo ABC 123"]), ("t3", "ambig", "Candle Therapeutics Inc", [], ["ambig plus"]), ("t4", None, None, None, ["AMBIG", None])], "nct_id string, brief_title string, lead_sponsor string, collaborators array<string>, names array<string>")
    got = {(r.nct_id, r.axp_id): (r.method, r.status) for r in registry.trial_links(t, aliases, programs).collect()}
    assert got == {("t1", "P1"): ("intervention_name", "auto"), ("t2", "P1"): ("intervention_text", "candidate"), ("t2", "P2"): ("title", "auto"), ("t3", "P3"): ("intervention_text", "auto"), ("t4", "P3"): ("intervention_name", "candidate")}


def test_survivor_chain_with_cycle(spark):
    chain = [(f"c{i}", "merged", f"c{i + 1}") for i in range(13)] + [("c13", "active", None)]
    p = spark.createDataFrame([*chain, ("x", "merged", "y"), ("y", "merged", "x"), ("z", "merged", "nowhere"), ("w", "active", "x")], "axp_id string, status string, replaced_by string")
    got = {r.axp_id: r.final_id for r in registry.survivors(p).collect()}
    assert {got[f"c{i}"] for i in range(14)} == {"c13"} and (got["x"], got["y"], got["z"], got["w"]) == ("y", "x", "z", "w")
    names = spark.createDataFrame([("c0", "Name One", "code", 0), ("z", "Two", "code", 0), ("w", "Two", "code", 0)], "axp_id string, alias string, alias_type string, ambiguous int")
    asked = spark.createDataFrame([("c0",), ("name-one",), ("TWO",), ("none",), ("AXP1",)], "query string")
    out = {r.query: (r.axp_id, r.n_programs, r.merged_from) for r in registry.resolve_names(asked, p, registry.alias_rows(names)).collect()}
    assert out == {"c0": (None, 0, None), "name-one": ("c13", 1, "c0"), "TWO": (None, 2, None), "none": (None, 0, None), "AXP1": (None, 0, None)}


def test_evaluation(spark):
    df = spark.createDataFrame([("v", ["v"]), ("v", ["w"]), ("v", []), (None, ["v"]), (None, [])], "t string, o array<string>").withColumn("g", F.lit("all"))
    r = evaluate.agreement(df, F.col("t"), F.col("o"), ["g"]).head()
    assert (r.tagged, r.supported, r.conflict, r.unsupported, r.missed, r.both_none) == (3, 1, 1, 1, 1, 1) and abs(r.low - 0.061492) < 1e-5
    lin = spark.createDataFrame([(1, ["r", "a", "b"]), (2, ["r"]), (3, [])], "id int, path array<string>")
    anchors = spark.createDataFrame([("r", "root"), ("a", "alpha")], "taxon string, category string")
    assert {x.id: x.category for x in evaluate.deepest(lin, anchors).collect()} == {1: "alpha", 2: "root"}


def test_logs(spark):
    df = spark.createDataFrame([("A:1;B:0",), ("A:3",), (None,)], "s string")
    assert {tuple(r) for r in logs.source_counts(df, "s").collect()} == {("A", 2, 0, 2.0, 4.0), ("B", 1, 1, 0.0, 0.0)}
    assert _one(spark, "ua:x", lambda c: logs.normal_client(F.col(c), {"ua:y": "z"})) == "x"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "log/day").mkdir(parents=True)
    (tmp_path / "log/day/a.json").write_text('{"event": "search", "n": 1}')
    (tmp_path / "r.xml").write_text("<set><rec><a>1</a></rec><rec><a>2</a></rec></set>")
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n3\n")
    plans, status = files.read_all(spark, [files.json_log("log", str(tmp_path / "log"), "event string, n int"), files.xml_records("xml", str(tmp_path / "r.xml"), "rec"), files.FileSource("gone", str(tmp_path / "no"))])
    assert plans["log"].count() == 1 and plans["xml"].count() == 2 and {r.source: r.status for r in status.collect()} == {"log": "ok", "xml": "ok", "gone": "failed"}
    rows, problems = files.strict_tsv(spark, str(tmp_path / "t.tsv"), ["a", "b"])
    assert [tuple(r) for r in rows.collect()] == [("1", "2")] and [r.problem for r in problems.collect()] == ["cells"]
    path = str(tmp_path / "table")
    mk = lambda rs: spark.createDataFrame(rs, "doi string, year int, v string")
    sinks.rewrite_partitions(mk([("a", 1, "old"), ("b", 2, "old")]), path, "year", ["doi"], [F.desc("v")])
    sinks.rewrite_partitions(mk([("a", 1, "new"), ("c", 1, "new")]), path, "year", ["doi"], [F.desc("v")])
    assert {(r.doi, r.v) for r in spark.read.parquet(path).collect()} == {("a", "old"), ("b", "old"), ("c", "new")}
    once = str(tmp_path / "once")
    assert [sinks.append_once(spark.createDataFrame([("d1", 1)], "d string, x int"), once, "d") for _ in range(2)] == [1, 0]
    up = str(tmp_path / "up")
    for v in (1, 2):
        sinks.upsert(spark.createDataFrame([("k", v)], "k string, v int"), up, F.col("k"), [F.desc("v")])
    assert [tuple(r) for r in spark.read.parquet(up).collect()] == [("k", 2)]
    made = []
    for _ in range(2):
        sinks.cached(spark, str(tmp_path / "cache"), sinks.signature(q="x", n=1), lambda: made.append(1) or spark.range(3).toDF("x")).count()
    assert len(made) == 1


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 02:00:00", "b"), (2, "2024-01-02 00:00:00", "a")]
    spark.createDataFrame(rows, "user_id int, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    days = streams.drain(streams.daily_counts(streams.read_stream(spark, str(tmp_path), "events"), "event_type"))
    assert {(str(r.day), r.event_type, r.n) for r in days.collect()} == {("2024-01-01", "a", 2), ("2024-01-01", "b", 1), ("2024-01-02", "a", 1)}
    sessions = streams.drain(streams.sessions(streams.read_stream(spark, str(tmp_path), "events"), "user_id"))
    assert sorted((r.user_id, r.n) for r in sessions.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_names_beyond_ascii_give_links(spark, tmp_path):
    import json
    import unicodedata

    from litspark.queries import registry as queries

    names = {"NCT00000001": "VV-β-AGFK10592", "NCT00000002": "ABC 123", "NCT00000003": "Δ-Vax ①", "NCT00000004": "unknown β"}
    alias = [("AXP000001", "vv β agfk10592"), ("AXP000002", "abc-123"), ("AXP000003", "∆vax1")]
    versions = [(i, n, "2024-01-01", json.dumps({"interventions": [{"name": names[n], "type": "DRUG"}]})) for i, n in enumerate(names)]
    spark.createDataFrame(versions, "version_id long, nct_id string, first_seen string, record string").write.parquet(f"{tmp_path}/trial_version.parquet")
    spark.createDataFrame([(*a, "brand", 0) for a in alias], "axp_id string, alias string, alias_type string, ambiguous int").write.parquet(f"{tmp_path}/alias.parquet")
    spark.createDataFrame([(a[0], "vaccine", "active", a[0], None, None) for a in alias], "axp_id string, modality string, status string, preferred_name string, sponsor string, originator string").write.parquet(f"{tmp_path}/program.parquet")
    spark.createDataFrame([], "article_id long, title string, abstract string, source string").write.parquet(f"{tmp_path}/articles.parquet")
    key = lambda x: "".join(c for c in unicodedata.normalize("NFKC", x.replace("∆", "Δ")).upper() if c.isalnum())
    brute = {(n, a) for n, x in names.items() for a, y in alias if key(x) == key(y)}
    rows = lambda f: {tuple(r) for r in f(spark, str(tmp_path)).collect()}
    narrow, wide = rows(queries.intervention_links), rows(queries.intervention_links_wide)
    assert len(brute) == 3 and narrow | wide == brute and not narrow & wide and len(wide) == 2
    assert rows(queries.modality_trials) | rows(queries.modality_trials_wide) == {(n,) for n, _ in brute}
    # the third name is short and not written as itself
    assert {r.axp_id: r.n_trials for r in queries.program_cards(spark, str(tmp_path)).collect()} == {"AXP000001": 1, "AXP000002": 1}


def test_late_rows_and_updates(spark, tmp_path):
    folder = tmp_path / "t"
    batches = [[("a", "2026-01-01 10:00:00")] * 3, [("a", "2026-01-01 11:00:00"), ("a", "2026-01-03 10:00:00")], [("c", "2026-01-03 10:30:00")], [("a", "2026-01-01 12:00:00"), ("b", "2026-01-03 11:00:00")]]
    for rows in batches:
        spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("append").parquet(str(folder / "e.parquet"))
        time.sleep(1.1)  # files are taken by the time they were written
    stream = streams.read_stream(spark, str(folder), "e", files_per_trigger=1)
    out = {(str(r.day), r.k): r.n for r in streams.drain(streams.daily_counts(stream, "k"), "update", ["day", "k"]).collect()}
    # the last row of the first day comes when the watermark has passed that day by more than a batch
    assert out == {("2026-01-01", "a"): 4, ("2026-01-03", "a"): 1, ("2026-01-03", "b"): 1, ("2026-01-03", "c"): 1}


def test_version_pairs_across_batches(spark, tmp_path):
    folder = tmp_path / "v"
    for rows in ([("n", "1", 1, "x"), ("n", "2", 2, "x"), ("m", "1", 3, "p")], [("n", "3", 4, "y"), (None, "1", 5, "z")], [("n", "2", 9, "late"), ("m", "2", 6, "q"), ("m", "3", 7, "p")]):
        spark.createDataFrame(rows, "nct_id string, seen string, vid long, rec string").coalesce(1).write.mode("append").parquet(str(folder / "t.parquet"))
        time.sleep(1.1)
    pairs = streams.drain(streams.version_pairs(streams.read_stream(spark, str(folder), "t", files_per_trigger=1)), "append")
    assert {(r.nct_id, r.vid, r.old, r.new) for r in pairs.collect()} == {("n", 4, "x", "y"), ("m", 6, "p", "q"), ("m", 7, "q", "p")}
