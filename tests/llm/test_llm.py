"""The text-corpus operators against brute force and on odd input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("litspark.llm")

from litspark.llm import canonical, leakage, linkage, packing, survivor, textnorm, titles, truncation  # noqa: E402


def test_survivors(spark):
    rows = [("g", 3, 1, "long text"), ("g", 2, 1, None), ("g", 1, 2, "longer text here"), ("h", 4, None, None), ("h", 5, None, None), (None, 6, 1, "x"), ("solo", 7, 1, "y"), ("t", 9, 1, "ab"), ("t", 8, 1, "cd")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "g string, i long, rank int, txt string, grp string")
    out = survivor.survivors(df, F.col("g"), F.col("i"), [F.col("rank"), F.col("txt").isNull().cast("int")], {"txt": F.col("txt")})
    assert {(r.grp, r.first_id, r.survivor_id, r.txt_id) for r in out.collect()} == {("g", 1, 3, 1), ("h", 4, 4, 0), ("t", 8, 8, 8)}
    assert survivor.survivors(df.limit(0), F.col("g"), F.col("i"), [F.col("rank")], {"txt": F.col("txt")}).count() == 0


@pytest.mark.parametrize("fan_in", [2, 4, 32])
def test_consensus(spark, fan_in):
    base = "a b c d e f g h"
    rows = [("x", base.replace("c", f"c{i}"), 1.0) for i in range(9)] + [("x", base, 1.0)] * 3 + [("y", "only one", 1.0), ("z", None, 1.0), ("z", "", 1.0), (None, "q", 1.0)]
    out = survivor.consensus(spark.createDataFrame(rows, "g string, v string, w double"), F.col("g"), F.col("v"), F.col("w"), fan_in)
    assert {(r.grp, r.value) for r in out.collect()} == {("x", base), ("y", "only one")}


def test_alignment_keeps_columns():
    one = lambda t: [{w: 1.0} for w in t.split()]
    merged = survivor.align(one("a b c d"), one("a x c d e"))
    assert [max(c, key=lambda t: (c[t], t)) for c in merged if "c" in c] == ["c"] and all(abs(sum(c.values()) - 2.0) < 1e-9 for c in merged)


def test_halved_alignments_are_as_good(monkeypatch):
    rnd = random.Random(11)
    one = lambda t: [{w: 1.0} for w in t]

    def score(a, b):
        total = 0.0
        rest_a, rest_b = iter(a), iter(b)
        for of_a, of_b in survivor._steps(a, survivor._Scorer(b), 0, len(b)):
            x, y = next(rest_a) if of_a else None, next(rest_b) if of_b else None
            total += -1.0 if x is None or y is None else 2.0 if x == y else -1.0
        assert next(rest_a, None) is None and next(rest_b, None) is None
        return total

    for _ in range(20):
        a, b = (one([rnd.choice("abcdef") for _ in range(rnd.randrange(1, 40))]) for _ in range(2))
        whole = score(a, b)
        monkeypatch.setattr(survivor, "MOST_CELLS", 30)
        assert score(a, b) == whole
        monkeypatch.undo()


def test_consensus_of_long_values():
    rnd = random.Random(12)
    base = [rnd.choice(WORDS) for _ in range(3000)]
    # different first and last words, so that nearly all words lie in the differing middle
    copies = [["x", *base, "end"], ["y", *base[:1500], *base[1510:], "stop"], ["z", *base[:700], "new", *base[700:], "final"]]
    profile = survivor.consensus_profile([(1.0, [{w: 1.0} for w in c]) for c in copies])
    agreed = [t for t in (survivor._leader(c) for c in profile) if t]
    assert agreed[1:-1] == base


def test_a_key_of_very_many_rows_fills_many_buckets(spark):
    df = spark.createDataFrame([(7, 30)] * 500 + [(i, 30) for i in range(100, 200)], "key long, n_tokens long")
    out = packing.pack(df, 100, bucket_rows=50).toPandas()
    assert len(out) == 600 and (out["key"] == 7).sum() == 500
    assert out.groupby("container")["n_tokens"].sum().max() <= 100 and (out["container"] % 12).nunique() > 6


def test_sum_of_squares_packs_within_capacity():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 101, 3000)
    container, offset = packing.sum_of_squares(sizes, 100)
    fill = np.bincount(container, weights=sizes)
    assert fill.max() <= 100 and fill.sum() == sizes.sum() and fill.mean() > 92
    for c in range(5):  # items of a container lie one after another
        at = np.flatnonzero(container == c)
        assert sorted(zip(offset[at], sizes[at], strict=True))[0][0] == 0 and np.all(np.sort(offset[at])[1:] == np.cumsum(sizes[at][np.argsort(offset[at])])[:-1])


def test_pack_splits_only_long_items(spark):
    rows = [(i, n) for i, n in enumerate([2048, 2049, 5000, 1, 0, 2047, 4096, 100] * 5)] + [(None, 5)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "key long, n_tokens long, h int, bucket int")
    out = packing.pack(df, 2048, bucket_rows=7).toPandas()
    parts = out.groupby("key").agg(n=("n_tokens", "sum"), k=("part", "count"))
    for i, n in rows:
        if i is not None and n:
            assert parts.loc[i, "n"] == n and parts.loc[i, "k"] == -(-n // 2048)
    assert out.groupby("container")["n_tokens"].sum().max() <= 2048
    assert packing.pack(df.limit(0), 2048).count() == 0
    again = packing.pack(df.repartition(3), 2048, bucket_rows=7).toPandas()
    assert sorted(map(tuple, out.to_numpy().tolist())) == sorted(map(tuple, again.to_numpy().tolist()))


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a" * 50_000)], "doc_id long, text string")
    got = {r.key: r.n_tokens for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and set(got) == {1, 4} and got[4] > 1000


REF = [("P1", "Quaxelgenvec", "inn", 0), ("P1", "KLG-706", "code", 0), ("P2", "Dramoltucel fervec", "inn", 0), ("P3", "AB1-vax", "synonym", 1), ("P4", "AB1-vax", "synonym", 1), ("P5", "MV-β-XYZ99", "synonym", 0), ("P1", "KLG-706", "code", 0)]


@pytest.mark.parametrize(
    ("typed", "want"),
    [
        ("KLG 706", "P1"), ("ｋｌｇ－７０６", "P1"), ("klg-7O6 (high dose)", "P1"), ("KLG-707", "NONE"), ("KLG-7061", "NONE"), ("KLG-706-2", "NONE"), ("study drug: QUAXELGENVEC™", "P1"), ("Quaxlegenvec", "P1"),
        ("dramoltucelfervec", "P2"), ("Dramoltukel fervec injection", "P2"), ("Dramoltucel", "NONE"), ("AB1 vax", "NONE"), ("mv-beta-xyz99", "P5"), ("placebo", "NONE"), ("  ", None), (None, None), ("?", "NONE"), ("x" * 5000, "NONE"),
    ],
)
def test_names(spark, typed, want):
    got = _mapped(spark)
    assert got.get(typed) == want


_CACHE: dict = {}


def _mapped(spark):
    if not _CACHE:
        typed = ["KLG 706", "ｋｌｇ－７０６", "klg-7O6 (high dose)", "KLG-707", "KLG-7061", "KLG-706-2", "study drug: QUAXELGENVEC™", "Quaxlegenvec", "dramoltucelfervec", "Dramoltukel fervec injection", "Dramoltucel", "AB1 vax", "mv-beta-xyz99", "placebo", "  ", None, "?", "x" * 5000]
        names = spark.createDataFrame([(i, t, "s") for i, t in enumerate(typed + ["KLG 706"] * 40)], "i long, t string, entry_id string")
        ref = spark.createDataFrame(REF, "a string, n string, ty string, amb int")
        out = canonical.map_names(names, "i", "t", ref, "a", "n", "amb").collect()
        assert len({r.row_id for r in out}) == len(out) == len(typed) - 2 + 40
        _CACHE.update({r.typed: r.entry_id for r in out})
        assert {r.entry_id for r in canonical.map_names(names, "i", "t", ref.limit(0), "a", "n", "amb").collect()} == {"NONE"}
        assert canonical.map_names(names.limit(0), "i", "t", ref, "a", "n", "amb").count() == 0
    return _CACHE


@pytest.mark.parametrize("name", ["onco of the very long name of a product", "alpha of beta gamma", "AB 12 CD 34 EF 56 GH 78"])
def test_long_names_map_to_themselves(spark, name):
    ref = spark.createDataFrame([("P1", name, 0), ("P2", "other", 0)], "axp_id string, alias string, ambiguous int")
    typed = spark.createDataFrame([(1, name), (2, name.upper()), (3, "no such name")], "i long, n string")
    out = canonical.map_names(typed, "i", "n", ref, "axp_id", "alias", "ambiguous")
    assert {(r.row_id, r.entry_id) for r in out.collect()} == {(1, "P1"), (2, "P1"), (3, canonical.NONE)}


def test_nearest_word_against_brute_force():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(6, 16))) for _ in range(150)]
    index = canonical.Vocabulary(words)
    missed = 0
    for w in words:
        t = list(w)
        i = rnd.randrange(len(t) - 1)
        t[i], t[i + 1] = t[i + 1], t[i]
        t = "".join(t)
        best = min(canonical.edits(t, x, 9) for x in words)
        found = index.nearest(t)
        missed += not found or found[0][1] != best
    assert missed == 0


def test_nearest_word_among_many_that_share_segments():
    rnd = random.Random(3)
    parts = ["vec", "gen", "tur", "mab", "lis", "ono", "pex", "fer"]
    words = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randrange(2, 6))) + rnd.choice("abcdefgh") for _ in range(20_000)})
    index = canonical.Vocabulary(words)
    for _ in range(40):
        t = list(rnd.choice(words))
        for _ in range(rnd.choice([1, 2])):
            i = rnd.randrange(len(t))
            t[i] = rnd.choice("abcxyz")
        t = "".join(t)
        own = canonical.allowance(len(t))
        near = [(w, d) for w in words if abs(len(w) - len(t)) <= own and (d := canonical.edits(t, w, own)) <= min(own, canonical.allowance(len(w)))]
        least = min((d for _, d in near), default=None)
        assert sorted(index.nearest(t)) == sorted((w, d) for w, d in near if d == least)


def test_nearest_words_do_not_depend_on_groups(spark):
    rnd = random.Random(5)
    names = sorted({"".join(rnd.choice(["vec", "gen", "tur", "mab", "lis", "ono", "pex", "fer"]) for _ in range(rnd.randrange(3, 5))) for _ in range(300)})
    ref = spark.createDataFrame([(f"P{i}", n, 0) for i, n in enumerate(names)], "e string, n string, a int")
    typed = [*names[::5], *(n[:4] + "x" + n[5:] for n in names[::3]), *(n[:-1] for n in names[::4])]
    df = spark.createDataFrame(list(enumerate(typed)), "i long, t string")
    rows = [{(r.row_id, r.entry_id, r.score) for r in canonical.map_names(df, "i", "t", ref, "e", "n", "a", vocab_group=g, token_bucket=b).collect()} for g, b in ((50_000, 200_000), (50, 40))]
    assert rows[0] == rows[1]
    best = {t: min(canonical.edits(t, n, 9) for n in names) for t in typed}
    index = canonical.Vocabulary(names)
    for i, entry, _ in rows[0]:
        near = index.nearest(typed[i])
        if len(near) == 1 and near[0][1] == best[typed[i]] and near[0][1] <= 2:
            assert entry == f"P{names.index(near[0][0])}"


def test_titles():
    n = lambda t: titles.normal(t)
    like = lambda a, b: titles.compare(n(a)[0], n(b)[0], n(a)[1], n(b)[1])
    base = "Targeting ABC1 with Julan-468: reversible capsid uptake and viral shedding in ferrets given oral dosing"
    assert like(base, base.upper() + ".") == (1.0, 0)
    assert like(base, base.replace("capsid", "cpasid"))[1] == 0 and like(base, base[:60] + "…")[1] == 0 and like(base, base.replace("viral ", ""))[1] == 0
    assert like(base, base + " in dogs")[1] == 1 and like(base + " in mice", base + " in dogs")[1] == 1 and like("Erratum: " + base, base)[1] == 1
    assert like(base + ": part I", base + ": part II")[1] == 1 and like(base, base.replace("468", "469"))[1] == 1
    assert like("", "")[0] == 1.0 and like("x " * 4000, "y " * 4000)[1] == 1


def test_linkage(spark):
    rnd = random.Random(4)
    genes = [f"GEN{i}" for i in range(40)]
    left, right = [], []
    for i in range(120):
        t = f"Targeting {rnd.choice(genes)} with Drug{chr(97 + i % 26)}{i}-{rnd.randrange(900)}: {rnd.choice(['robust', 'partial', 'delayed'])} capsid uptake and shedding in {rnd.choice(['ferrets', 'pigs', 'rats'])} given dose"
        doi = f"10.1/{i}" if i % 3 else None
        left += [(f"a{i}", t, doi, False, [doi], 2000 + i % 9, "J"), (f"b{i}", t.upper(), None, False, [None], None, None)]
        if i % 2:
            right.append((f"p{i}", t.replace("capsid", "cpasid"), doi, False, [doi], 2000 + i % 9, "J"))
        else:
            right.append((f"q{i}", "Erratum: " + t, f"10.2/{i}", False, [f"10.2/{i}"], 2000 + i % 9 + 3, "K"))
    schema = "id string, title string, work string, preprint boolean, dois array<string>, year int, journal string"
    out = linkage.link(spark.createDataFrame(left + [(None, None, None, None, None, None, None)], schema), spark.createDataFrame(right, schema))
    got = {(r.l_id, r.r_id) for r in out.where("confidence >= 0.5").collect()}
    assert got == {(f"{s}{i}", f"p{i}") for i in range(1, 120, 2) for s in "ab"}
    assert linkage.link(spark.createDataFrame([], schema), spark.createDataFrame(right, schema)).count() == 0


def test_misspelt_and_cut_titles_meet(spark):
    rnd = random.Random(8)
    fill = [f"w{chr(97 + i)}{chr(97 + i)}ord" for i in range(26)]
    left, right = [], []
    for i in range(60):
        words = [rnd.choice(fill[:8]), *rnd.sample(fill, 8), f"drug{i}x", f"gene{i}y", *rnd.sample(fill, 4)]
        left.append((f"a{i}", " ".join(words), []))
        bad = list(words)
        if i % 3 == 0:  # all rare words and one more misspelt
            bad[9], bad[10], bad[11] = f"drg{i}qx", f"gee{i}qy", f"zz{i}"
        elif i % 3 == 1:  # cut before the rare end
            bad = bad[:9]
        else:  # two misspelt words beside the rare ones
            bad[2], bad[3], bad[4] = f"yy{i}", f"vv{i}", f"uu{i}"
        right.append((f"p{i}", " ".join(bad), []))
    side = lambda rows: spark.createDataFrame([(int(i[1:]), linkage.normal(t)[0]) for i, t, _ in rows], "t long, norm string")
    got = {(f"a{r.l_t}", f"p{r.r_t}") for r in linkage.candidates(side(left), side(right), 20_000).collect()}
    near = lambda x, y: len(set(x.split()) & set(y.split())) >= 0.7 * min(len(set(x.split())), len(set(y.split())))
    assert {(f"a{i}", f"p{i}") for i in range(60)} <= got
    assert {(x[0], y[0]) for x in left for y in right if near(x[1], y[1]) and x[0][1:] == y[0][1:]} <= got


def _title_sides(spark, *sides):
    return [spark.createDataFrame([(i, t) for i, t in enumerate(x)], "t long, norm string") for x in sides]


@pytest.mark.parametrize("room", [1000, 7])
def test_first_words_of_very_many_titles_are_keys(spark, monkeypatch, room):
    monkeypatch.setattr(linkage, "ROOM", room, raising=False)
    rnd = random.Random(12)
    fill = [f"w{chr(97 + i)}{chr(97 + i)}ord" for i in range(26)]
    right = sorted({" ".join(["a phase one trial of oral dosing", *rnd.sample(fill, 6 + i % 3), f"end{i}x"]) for i in range(120)})
    # cut after a few words, with a word misspelt, or with other words behind the first ones
    left = sorted({" ".join(t.split()[: 9 + i % 3]) if i % 3 else t.replace("word", "wrod", 2).replace(f"end{t.split('end')[1]}", f"zz{i}") for i, t in enumerate(right)} | {" ".join(["a phase one trial of oral dosing", *(f"other{i}{j}" for j in range(9))]) for i in range(5)})
    got = {(r.l_t, r.r_t) for r in linkage.candidates(*_title_sides(spark, left, right), 20_000).collect()}
    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if any(titles.compare(x, y, c, False)[0] >= linkage.ALIKE for c in (True, False))}
    assert want <= got and len(want) > 120


@pytest.mark.parametrize("frequent", [0, 3, 25])
def test_candidates_do_not_depend_on_the_words_sent(spark, frequent):
    rnd = random.Random(13)
    fill = [f"w{chr(97 + i)}{chr(97 + i)}ord" for i in range(26)]
    one = lambda i: " ".join([*rnd.sample(fill, 9), f"drug{i % 40}x"])
    sides = _title_sides(spark, *[sorted({one(i) for i in range(n)}) for n in (150, 90)])
    want, got = ({(r.l_t, r.r_t) for r in linkage.candidates(*sides, k).collect()} for k in (20_000, frequent))
    assert got == want and len(want) > 100


def test_registrants_beyond_a_thousand_count(spark, tmp_path, monkeypatch):
    from litspark.llm import queries

    rows = [(i, "a title", "EPMC", f"10.{1000 + i // 2}/x{i}", None) for i in range(2400)] + [(9000, "a title", "EPMC", "10.99999/p1", "10.1000/x0")]
    articles = spark.createDataFrame(rows, "article_id long, title string, source string, doi string, published_doi string")
    articles.selectExpr("*", "'2020-01-01' as publication_date", "'J' as journal").write.parquet(f"{tmp_path}/articles.parquet")
    papers = spark.createDataFrame([("1", "a title", "J", 2020, "10.99999/p2"), ("2", "a title", "J", 2020, None)], "pmid string, title string, journal string, pub_year int, doi string")
    papers.write.parquet(f"{tmp_path}/paper.parquet")
    monkeypatch.setattr(queries.linkage, "link", lambda left, right: (left, right))
    left, right = queries._links(spark, str(tmp_path))
    assert {r.id: r.preprint for r in right.collect()} == {"1": True, "2": None} and left.count() == 2401
    assert left.where("preprint").count() == 0


def test_title_keys_widen_with_the_corpus():
    rare, often = linkage.keys_of("a b c d e f g h", dict.fromkeys("bcdefg", 30), 1000), linkage.keys_of("a b c d e f g h", dict.fromkeys("bcdefg", 400), 1000)
    assert "b|c" in rare and "b|c" not in often and "a" in rare and "h" in often and "^abcdefg" in often
    # three of 400 in 1,000 are expected in 64 titles, five in 10: all six are taken
    assert "b|c|d" not in often and "b|c|d|e|f|g" in often
    # at any size of the corpus no set of words is expected in more than RARE titles, as long as there are words left
    for n in (10**3, 10**5, 10**7):
        for k in linkage.keys_of("a b c d e f g h", dict.fromkeys("abcdefgh", n // 100), n):
            if "|" in k:
                assert n * 0.01 ** len(k.split("|")) <= linkage.EXPECTED
    # words beyond the bound are as frequent as the last within it
    assert "a" not in linkage.keys_of("a b c d", {"c": 900, "d": 900}, 1000, floor=500)


def test_titles_of_very_many_rows(spark):
    schema = "id string, title string, work string, preprint boolean, dois array<string>, year int, journal string"
    right = [(f"p{i}", "Correction", None, None, [], 1900 + i % 100, f"J{i % 70}") for i in range(300)] + [("q", "A title of its own about one thing", None, None, [], 2001, "J")]
    left = [("a", "Correction", None, None, [], 1907, "J7"), ("b", "A title of its own about one thing", None, None, [], 2001, "J"), ("c", "Correction", None, None, [], None, None)]
    out = {(r.l_id, r.r_id) for r in linkage.link(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    near = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] == "Correction" and x[5] and abs(x[5] - y[5]) <= 1 and x[6] == y[6]}
    assert out == near | {("b", "q")}


def _passage(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("ton", "bel", "dar", "fim", "gus", "hek", "jol")]


def test_leakage_against_brute_force(spark):
    rnd = random.Random(6)
    items = [(i, _passage(rnd, 90)) for i in range(8)] + [(90, None), (91, ""), (92, "too short")]
    docs, want = [(900, None), (901, ""), (902, _passage(rnd, 4000))], set()
    for d in range(40):
        text = _passage(rnd, rnd.randrange(5, 300)).split()
        if d % 2:
            i = rnd.randrange(8)
            n = rnd.choice([34, 60, 90, 18])
            s = rnd.randrange(90 - n + 1)
            run = items[i][1].split()[s : s + n]
            for k in range(9, n, 11):
                run[k] = "changed"
            at = rnd.randrange(len(text))
            text[at:at] = [w.upper() + "," for w in run]
            if n >= 30:
                want.add((d, i))
        docs.append((d, "<p>" + " ".join(text) + "</p>"))
    found = leakage.contained_passages(spark.createDataFrame([(*x, 1) for x in docs], "k long, t string, item_id int"), "k", "t", spark.createDataFrame(items, "k long, p string"), "k", "p", group_items=3)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    none = spark.createDataFrame([], "k long, p string")
    assert leakage.contained_passages(spark.createDataFrame(docs, "k long, t string"), "k", "t", none, "k", "p").count() == 0


def test_leakage_at_the_edge_in_long_texts(spark):
    rnd = random.Random(12)
    items = [(i, " ".join(rnd.sample([a + b for a in WORDS for b in WORDS], 60))) for i in range(6)]  # no word twice: one best alignment
    docs = []
    for d, (i, n, edits) in enumerate((i, n, edits) for i in range(6) for n, edits in ((30, (7, 15, 22)), (32, (6, 12, 19, 25)))):
        run = items[i][1].split()[10 : 10 + n]
        for k in edits:
            run[k] = "changed"
        text = [f"other{rnd.randrange(900)}" for _ in range(5000 if d % 4 < 2 else 600)]
        text[300:300] = run
        docs.append((d, " ".join(text), i))
    found = leakage.contained_passages(spark.createDataFrame(docs, "k long, t string, i int"), "k", "t", spark.createDataFrame(items, "k long, p string"), "k", "p")
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, i) for d, _, i in docs}
    assert leakage.fewest_hits(30, 8) == 8


@pytest.mark.parametrize("n_words", [300, 1_500, 5_000, 20_000, 80_000])
def test_leakage_recall_by_length(n_words):
    rnd = random.Random(n_words)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    items = [(i, " ".join(rnd.sample(vocabulary, 90))) for i in range(40)]
    px = leakage.Passages(items)
    plans = [(30, 0), (30, 3), (32, 3), (32, 4), (40, 4), (40, 5), (90, 11)]
    keys, texts, want = [], [], set()
    for i in range(40):
        n, edits = plans[i % len(plans)]
        run = items[i][1].split()[:n]
        places = [(j + 1) * n // (edits + 1) for j in range(edits)]
        for x in sorted(places, reverse=True):  # changed, dropped and added words
            run[x : x + 1] = [["changed"], [], [run[x], "added"]][(x + i) % 3] if n > 30 + edits else ["changed"]
        # filler of the passages' own words, so that chance hits occur too
        filler = [rnd.choice(vocabulary if rnd.random() < 0.5 else WORDS) for _ in range(n_words)]
        at = rnd.randrange(n_words)
        filler[at:at] = run
        keys.append(i)
        texts.append(" ".join(filler))
        want.add((i, i))
    found = {(d, i) for d, i, n in leakage.search_batch(keys, texts, px, 30, 8, 6, 0.2)}
    assert found == want


def test_banded_alignments_against_plain_ones():
    rnd = np.random.default_rng(5)
    band = 4
    for _ in range(60):
        n = int(rnd.integers(1, 12))
        p, d = rnd.integers(0, 4, (1, n)), rnd.integers(0, 4, (1, n + 2 * band))
        matched, inserted = leakage._aligned(p, d, band)
        got = (n - matched.sum()) + inserted.sum()
        # plain: a free stretch of text before and behind, begins and ends inside the band
        best = [[0 if j <= 2 * band else 99 for j in range(n + 2 * band + 1)]]
        for i in range(1, n + 1):
            row = [99] * (n + 2 * band + 1)
            for j in range(i, i + 2 * band + 1):
                row[j] = min(best[-1][j - 1] + int(p[0, i - 1] != d[0, j - 1]) if j else 99, best[-1][j] + 1 if j <= i - 1 + 2 * band else 99, row[j - 1] + 1 if j > i else 99)
            best.append(row)
        assert got == min(best[-1][n : n + 2 * band + 1])


def test_longest_run():
    one = lambda bad, n=40: leakage.longest_run(np.array([int(i in bad) for i in range(n)]), 8)
    assert one(set()) == 40 and one({20}) == 40 and one(set(range(0, 40, 2))) < 10 and one({12, 13, 14}) == 40


def test_clean_text():
    assert textnorm.words("A <b>bold</b> caf&eacute; longâ€“term Ｔest​ing") == ["a", "bold", "café", "long", "term", "testing"]


@pytest.mark.parametrize(
    ("text", "complete"),
    [
        ("It ends here.", True), ("Asked “is it enough?”", True), ("Details follow elsewhere (see Table 2)", True), ("<p>It ends here.</p>", True), ("It goes on [...]", False), ("It goes on &hellip;", False), ("unchanged (p = 5.", False),
        ("A broken <su", False), ("an entity &am", False), ("(an open bracket", False), ("An open end", False), ("", True),
    ],
)
def test_open_ends(text, complete):
    assert (truncation.tail_of(text) is None) == complete


def test_truncation(spark):
    rnd = random.Random(8)
    subjects, verbs, things = ["The panel", "Our group", "The sponsor", "One centre"], ["confirmed", "repeated", "reported"], ["lasting benefit in children", "partial response in adults", "viral shedding in ferrets"]
    sentence = lambda: f"{rnd.choice(subjects)} {rnd.choice(verbs)} {rnd.choice(things)} after {rnd.randrange(90)} weeks of treatment."
    docs, want = [], set()
    for i in range(400):
        t = " ".join(sentence() for _ in range(rnd.randrange(4, 9)))
        kind = i % 10
        if kind == 0:
            t = t[: t.rindex("weeks") + rnd.choice([2, 3])]
        elif kind == 1:
            t = t[: t.rindex(" after")] + " [...]"
        elif kind == 2:
            t = t[:-1]
        elif kind == 3:
            t += "\nKeywords: gene therapy, ferrets"
        if kind in (0, 1):
            want.add(i)
        docs.append((i, t, "src"))
    docs += [(1000 + i, docs[10][1] + " ", "other") for i in range(50)] + [(2000, None, "s"), (2001, "", None), (2002, "word " * 30_000 + "end.", "s")]
    want |= {1000 + i for i in range(50)}
    full = docs[5][1]
    docs += [(3000, full + " And one more sentence follows.", "s"), (3001, full[:100], "s")]
    want |= {3001}
    df = spark.createDataFrame([(*x, 1) for x in docs], "k long, t string, s string, h int")
    found = {r.doc_id: r.why for r in truncation.truncated(df, "k", "t", "s").collect()}
    assert set(found) == want and found[3001] == "longer copy"
    assert truncation.truncated(df.limit(0), "k", "t", "s").count() == 0


def _longer(spark, texts, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(truncation._hash(t), truncation.bare(t)[1]) for t in texts], "h long, squeezed string")
        found = {r.h for r in truncation.longer_copies(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    return {t for t in texts if truncation._hash(t) in found}


@pytest.mark.parametrize("partitions", [1, 2, 8, 32, 64])
def test_longer_copies_at_any_partition_count(spark, partitions):
    rnd = random.Random(9)
    full = [" ".join(rnd.choice(WORDS) for _ in range(30)) + "." for _ in range(12)]
    cut_short = [t[: rnd.randrange(20, 150)].rstrip() for t in full]
    # a sentence that is complete in one copy goes on in another one
    both = ["the end of it", "the end of it. Then more", "the end of its kind", "no longer one", "no longer one. More"]
    texts = full + cut_short + both + [cut_short[0].upper(), cut_short[1] + " [...]"]
    want = {t for t in texts for u in texts if len(truncation.bare(u)[1]) > len(b := truncation.bare(t)[1]) and truncation.bare(u)[1].startswith(b) and truncation.bare(u)[1][len(b)] not in ".!?"}
    assert _longer(spark, texts, partitions) == want and set(cut_short) | {"the end of it"} <= want and "no longer one" not in want


@pytest.mark.parametrize("per_key", [16, 0])
def test_short_cut_texts_meet_their_longer_copies(spark, per_key):
    rnd = random.Random(10)
    # sentences whose ends are not open, so that only the longer copy tells; the ends of the short ones go on nowhere else
    docs, want = [], set()
    for i in range(60):
        t = " ".join([f"Item{i}x", *(rnd.choice(WORDS) for _ in range(20))])
        n = 20 + 2 * (i % 20)
        docs += [(2 * i, t + " <i>etc</i> here.", "s"), (2 * i + 1, t[:n].replace(" ", "  ", 1).rstrip(), "r")]
        want.add(2 * i + 1)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    ends = truncation.ends_of(df).cache()
    live = truncation.live_prefixes(ends)
    wanted = ends.select(F.explode("keys").alias("key")).where("key <> 0").distinct()
    # with no bits at all for a key the filters let everything through: slower, but not wrong
    seen = truncation.whole_pass(df, wanted, live, per_key) if per_key else truncation.whole_pass(df, wanted, live, 1, 1)
    found = truncation.longer_copies(seen.where("h is not null"))
    got = {r.doc_id for r in ends.where("keys is not null").join(found, "h", "left_semi").collect()}
    assert got == want
    counts = {r["key"]: (r.n, r.stop) for r in seen.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.sum("stop").alias("stop")).join(wanted, "key").collect()}
    plain: dict = {}
    for _, t, _ in docs:
        ids = truncation._ids(truncation.tidy(t).rstrip(), {}) + [0]
        kept = np.array([x for x in ids if x != truncation.MID], dtype=np.int64)
        nxt = [ids[k + 1] if k + 1 < len(ids) else 0 for k, x in enumerate(ids) if x != truncation.MID]
        for size, keys in truncation.group_keys(kept).items():
            for k, (x, y) in enumerate(zip(kept, nxt, strict=True)):
                if x > truncation.MID and y and k + 1 >= size:
                    a, b = plain.get(int(keys[k]), (0, 0))
                    plain[int(keys[k])] = (a + 1, b + (y == truncation.END))
    keys = {r["key"] for r in wanted.collect()}
    assert counts == {k: v for k, v in plain.items() if k in keys}


def test_several_passes_count_the_same(spark):
    df = spark.createDataFrame([(i, f"{WORDS[i % 7]} {WORDS[i % 5]} goes on with {WORDS[i % 6]} {WORDS[i % 7]} {WORDS[i % 5]} {WORDS[i % 4]}", "s") for i in range(200)], "doc_id long, text string, source string")
    ends = truncation.ends_of(df)
    wanted, none = ends.select(F.explode("keys").alias("key")).where("key <> 0").distinct(), ends.select(F.lit(1).cast("long").alias("key")).limit(0)
    rows = []
    for most in (1 << 11, 1):  # one slice of 2^19 bits at 2^13 bits a key: 64 keys a pass
        seen = truncation.whole_pass(df, wanted, none, 16 if most > 1 else 1 << 13, most)
        rows.append({(r["key"], r.n, r.stop) for r in seen.groupBy("key").agg(F.sum("n").alias("n"), F.sum("stop").alias("stop")).join(wanted, "key").collect()})
    assert rows[0] == rows[1] and len(rows[0]) > 5


def test_batches_without_longer_copies(spark):
    # one task meets the prefix of an open text, the other ones none
    rows = [("The sponsor reported lasting benefit in",), ("The sponsor reported lasting benefit in children.",)]
    df = spark.createDataFrame(rows, "text string").coalesce(1).unionAll(spark.createDataFrame([(f"{WORDS[i % 7]} has ended.",) for i in range(20)], "text string"))
    df = df.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.lit("s").alias("source"))
    assert df.rdd.getNumPartitions() > 1
    assert {(r.doc_id, r.why) for r in truncation.truncated(df, "doc_id", "text", "source").collect()} == {(0, "longer copy")}
