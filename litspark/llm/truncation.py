"""Texts that were cut short: found by prefix self-join, and by what the corpus says about their last words.

A text is cut where it ends within a word or a sentence.  Three kinds of evidence, each taken over all texts:

* a longer copy (``longer_copies``): every text is hashed at the fixed prefix lengths of ``LADDER`` (characters without
  blanks, markup, case and entities); an open text meets the others by the longest of them that it fills.  Values that
  meet another one are sorted, with the ends of sentences behind all other characters, so a value is a strict prefix of
  a longer one that goes on within the sentence exactly if its successor in the order is one;
* the last words: how often the same last words go on, and how often they end a sentence, elsewhere in the corpus; a
  last word that is no word of the corpus is a stump (``whole_pass``);
* the length: texts of one source that lack an end pile up at the source's field limit (``piles``).

Open structures at the end (a tag, an entity, a bracket) and signs such as ``[...]`` are read from the text itself.

Scale: the texts are read twice.  The first pass reduces each to its end, its hashes and its length; the second, over
whole texts, counts the wanted word groups and hands out the texts that may have a longer copy, both chosen by Bloom
filters whose size follows the number of wanted keys (16 bits a key, 128 MB at most; more keys than that take several
passes).  False hits of a filter only cost time: keys are compared exactly afterwards.  Counts are added up within each
batch before the shuffle.  No group of copies is gathered: equal texts collapse to one, and the sort is by range.

Defined results: null and empty texts are never cut; a text that ends in a complete sentence, a heading, list item,
label line or just without its full stop is not cut; copies of a cut text (equal but for case, blanks and markup) are
cut, whoever delivers them; a text shorter than the first step of the ladder has no longer copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.llm.filters import Filter, slices_of
from litspark.llm.textnorm import tidy
from litspark.session import cut, shuffle_partitions

TAIL = 400
LADDER = (16, 64, 256, 1024)
_ZERO_WIDTH = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff\u00ad"))
# ends of sentences, and the characters behind all others that stand for them in the order
_ENDS, _LATE = ".!?", "\U0010fffb\U0010fffc\U0010fffd"
# Signs by which senders mark a cut.
_SURE = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|…|&hellip;?|[\[(](?:truncated|read more|more|continued|cut)[\])]|(?:\.\.\.|…)\s*(?:more|read more|continued)|<truncated>)\s*$", re.IGNORECASE)
_DOTS = re.compile(r"\s*\.\.+\s*$")
_TERMINAL = re.compile(r"[.!?][\"'”’»)\]]*(?:\s*</?[a-zA-Z][^<>]*>)*\s*$")
_CLOSED = re.compile(r"\((?:see|cf\.?|ref\.?|table|figure|fig\.?)[^()]*\)(?:\s*</?[a-z][^<>]*>)*\s*$", re.IGNORECASE)
SIZES = (1, 2, 3, 4, 6)
_OPEN_TAG = re.compile(r"<[a-zA-Z/!][^<>]*$|<$")
_OPEN_ENTITY = re.compile(r"&(?:#[0-9xX]?[0-9a-fA-F]*|[a-zA-Z]{1,8})?$")
_BREAK = re.compile(r"\n+|</?(?:p|br|li|div|ul|h\d)\b[^<>]*>")
_TRAILER = re.compile(r"^(?:[-•*–]\s|[A-Z][\w ]{1,28}:\s|(?:[Rr]egistered|[Tt]rial registration)\b|https?://|\S+@\S+$|©|DOI)")
# a closing bracket does not come between a word and what follows it
_TOKEN = re.compile(r"\w+(?:['’]\w+)*|[.!?…]+|\n+|[,;:(]")
_SEED = 7
END, MID = 1, 2


def _token_id(token: str) -> int:
    """A stable id: sentence ends, inner marks, numbers and symbols by class, words by their spelling."""
    c = token[0]
    if c in ".!?…\n":
        return END
    if c in ",;:(":
        return MID
    if any(ch.isdigit() for ch in token):
        return 3
    if len(token) > 1 and token.isupper():
        return 4
    return xxhash.xxh64_intdigest(token.lower(), _SEED) >> 1 | 16


def _ids(text: str, memo: dict[str, int]) -> list[int]:
    tokens = _TOKEN.findall(text)
    try:
        return [memo[t] for t in tokens]
    except KeyError:
        if len(memo) > 2_000_000:
            memo.clear()
        for t in tokens:
            if t not in memo:
                memo[t] = _token_id(t)
        return [memo[t] for t in tokens]


def group_keys(kept: np.ndarray) -> dict[int, np.ndarray]:
    """For each size of ``SIZES`` the keys of the tokens that end at each place."""
    x = kept.astype(np.uint64)
    h, out = np.full(len(x), np.uint64(0x51ED270B)), {}
    for i in range(SIZES[-1]):
        part = np.zeros(len(x), dtype=np.uint64)
        part[i:] = x[: max(0, len(x) - i)]
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        if i + 1 in SIZES:
            out[i + 1] = h.view(np.int64)
    return out


def _squeezed(tidied: str) -> str:
    plain = "".join(tidied.split()).lower()
    return plain if plain.isascii() else plain.translate(_ZERO_WIDTH)


def bare(text: str, tidied: str | None = None) -> tuple[str, str]:
    """(squeezed text, the same without the sign of a cut and what is open at its end): no blanks, markup and entities, lower case."""
    squeezed = _squeezed(tidy(text) if tidied is None else tidied)
    t = text.rstrip()
    end = t[-TAIL:]
    m = _SURE.search(end) or _DOTS.search(end) if end[-1:] in ".…>])eED;" or "hellip" in end[-9:] else None
    kept = end[: m.start()] if m else end
    if not _TERMINAL.search(kept) and (o := _OPEN_TAG.search(kept) or _OPEN_ENTITY.search(kept)):
        kept = kept[: o.start()]
    if len(kept) == len(end):
        return squeezed, squeezed
    return squeezed, _squeezed(tidy(t[: len(t) - len(end)] + kept))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def ladder(squeezed: str) -> list[int]:
    """Hashes of the prefixes of each length of ``LADDER`` that the text fills."""
    return [_hash(f"{n} {squeezed[:n]}") for n in LADDER if len(squeezed) >= n]


def tail_of(text: str) -> tuple[bool, int, int, list[int]] | None:
    """(sure evidence of a cut, sign, trailer, keys of the last word groups) of an open end; None for a complete one.

    text: the last characters of a text.  sign: 2 a sure sign, 1 dots, 0 none.
    """
    t = text.rstrip()
    sign = 2 if (m := _SURE.search(t)) else 1 if (m := _DOTS.search(t)) else 0
    body = t[: m.start()].rstrip() if m else t
    if not body:
        return None
    if _TERMINAL.search(body):
        # a number that was cut after its point is open, and so is any end inside a bracket that was opened shortly before
        if not (re.search(r"\([^()]{0,40}\d\.$", body) and not sign):
            return None
        return True, sign, 0, []
    tag, entity = _OPEN_TAG.search(body), _OPEN_ENTITY.search(body)
    bracket = body.rfind("(") > body.rfind(")") and len(body) - body.rfind("(") < 160
    sure = bool(tag or entity) or body.endswith(("�", ",", "(", "“", "[")) or (bracket and sign == 0)
    if not sign and not sure and _CLOSED.search(body):
        return None
    lines = [x for x in _BREAK.split(body) if x.strip()]
    trailer = 0
    if len(lines) > 1:
        last, before = lines[-1].strip(), lines[-2].strip()
        short = len(last.split()) <= 14
        place = re.fullmatch(r"(?:[A-Z][\w.’'-]*|of|the|for|and|de|la|,|&)(?:,? (?:[A-Z][\w.’'-]*|of|the|for|and|de|la))*", last) is not None
        trailer = int(short and (bool(_TRAILER.match(last)) or (place and bool(_TERMINAL.search(before))) or bool(_TRAILER.match(before) and before.startswith(("-", "•", "*")))))
    tidied = tidy(body[: tag.start()] if tag else body[: entity.start()] if entity else body)
    ids = np.array([i for i in _ids(tidied, {}) if i != MID], dtype=np.int64)
    while len(ids) and ids[-1] == END:
        ids = ids[:-1]
    if len(ids) < 2:
        return sure, sign, trailer, []
    groups = group_keys(ids)
    keys = [int(groups[k][-1]) if len(ids) >= k else 0 for k in SIZES] + [int(groups[2][-2]) if len(ids) > 2 else 0]
    # numbers, symbols and names are never stumps
    word = re.findall(r"\w+", tidied)[-1:]
    if ids[-1] < 16:
        keys[0] = keys[-1] = 0
    elif not word or not word[0][0].islower():
        keys[-1] = 0
    return sure, sign, trailer, keys


def ends_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, len, h, ladder of every text, and sure, sign, trailer, keys of those that lack an end (else null).

    h hashes the whole squeezed text, ladder its prefixes without the sign of a cut.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            out = b[["doc_id", "source"]].copy()
            both = [bare(t) for t in texts]
            out["len"] = [len(t) for t in texts]
            out["h"] = [_hash(s) for s, _ in both]
            out["ladder"] = [ladder(s) for _, s in both]
            found = [tail_of(t[-TAIL:]) or (None, None, None, None) for t in texts]
            for i, name in enumerate(("sure", "sign", "trailer", "keys")):
                out[name] = pd.Series([f[i] for f in found], dtype=object, index=out.index)
            yield out

    narrow = docs.select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    return narrow.mapInPandas(run, "doc_id long, source string, len int, h long, ladder array<long>, sure boolean, sign int, trailer int, keys array<long>")


def whole_pass(docs: DataFrame, wanted: DataFrame, live: DataFrame, per_key: int = 16, most: int = 1 << 11) -> DataFrame:
    """One pass over the whole texts: how word groups go on, and texts that share a prefix with an open one.

    Rows with a key: n, how often the word group occurs, and stop, how often it ends a sentence (the last words of a text
    count neither way).  Rows with an h: squeezed, the text in the order of ``longer_copies``.
    wanted: key, of the word groups; live: key, of the prefixes.
    """
    spark = docs.sparkSession
    n_wanted, n_live = wanted.count(), live.count()
    capacity = (most << Filter.BITS) // per_key  # keys of one pass
    parts = []
    for turn in range(passes := max(1, -(-max(n_wanted, n_live) // capacity))):
        share = lambda df, turn=turn: df.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == turn) if passes > 1 else df
        filters = spark.sparkContext.broadcast([Filter.of(share(df), slices_of(-(-n // passes), per_key, most)).words for df, n in ((wanted, n_wanted), (live, n_live))])

        def run(batches: Iterator[pd.DataFrame], filters=filters) -> Iterator[pd.DataFrame]:
            memo: dict[str, int] = {}
            groups, prefixes = (Filter(w) for w in filters.value)
            for b in batches:
                texts = b["text"].tolist()
                tidied = [tidy(t) for t in texts]
                for i in range(0, len(texts), 2000):
                    flat: list[int] = []
                    for t in tidied[i : i + 2000]:
                        flat += _ids(t.rstrip(), memo)
                        flat.append(0)
                    full = np.array(flat, dtype=np.int64)
                    following = np.append(full[1:], 0)
                    keep = full != MID
                    kept, nxt = full[keep], following[keep]
                    place = np.arange(len(kept))
                    since = place - np.maximum.accumulate(np.where(kept == 0, place, -1))  # 1 for the first word of a text
                    counts = np.flatnonzero((kept > MID) & (nxt != 0))
                    stop = (nxt == END)[counts]
                    found = []
                    for k, key in group_keys(kept).items():
                        key = key[counts]
                        hit = groups.hits(key)
                        hit = hit[since[counts[hit]] >= k]
                        uniq, inv = np.unique(key[hit], return_inverse=True)
                        ends = np.bincount(inv, weights=stop[hit], minlength=len(uniq)).astype(np.int64)
                        found.append(pd.DataFrame({"key": uniq, "n": np.bincount(inv, minlength=len(uniq)).astype(np.int64), "stop": ends}))
                    yield pd.concat(found).astype({"key": "Int64", "n": "Int64", "stop": "Int64"}).assign(h=pd.NA, squeezed=None)
                if n_live:
                    both = [bare(t, x) for t, x in zip(texts, tidied, strict=True)]
                    steps = [ladder(s) for _, s in both]
                    owner = np.repeat(np.arange(len(steps)), [len(x) for x in steps])
                    of = sorted(set(owner[prefixes.hits(np.array([x for y in steps for x in y], dtype=np.int64))].tolist()))
                    rows = {both[x]: None for x in of}  # copies within the batch are one
                    if rows:  # without any, pandas would make squeezed a column of numbers, which Arrow can't turn into strings
                        yield pd.DataFrame({"key": pd.NA, "n": pd.NA, "stop": pd.NA, "h": [_hash(s) for s, _ in rows], "squeezed": [s for _, s in rows]})

        parts.append(docs.select("text").mapInPandas(run, "key long, n long, stop long, h long, squeezed string"))
    return reduce(DataFrame.unionByName, parts)


def live_prefixes(ends: DataFrame) -> DataFrame:
    """key of the prefixes that are the longest of an open text and stand at the beginning of another one too."""
    steps = ends.select("h", F.posexplode("ladder").alias("at", "key"), (F.col("keys").isNotNull() & (F.col("at") == F.size("ladder") - 1)).alias("own"))
    return steps.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("own")).where("own and lo <> hi").select("key")


def piles(ends: DataFrame) -> DataFrame:
    """source, len, at: whether open ends of this source pile up around (1) or exactly at (2) this length."""
    both = ends.groupBy("source", "len").agg(F.count_if(F.col("trailer") == 0).alias("n"), F.count("*").alias("n_all")).where("n > 0")
    w = Window.partitionBy("source").orderBy("len")
    near, wide = F.sum("n").over(w.rangeBetween(-10, 10)), F.sum("n").over(w.rangeBetween(-200, 200))
    exact = (F.col("n") >= 4) & (F.col("n") >= 0.5 * F.col("n_all")) & (F.col("n") >= 0.2 * wide)
    around = (near >= 6) & (near >= 0.3 * wide)
    return both.select("source", "len", F.when(exact, 2).when(around, 1).otherwise(0).alias("at"))


def longer_copies(texts: DataFrame) -> DataFrame:
    """h of texts that are strict prefixes of a longer one which goes on within the sentence.  texts: h, squeezed."""
    once = texts.select("h", F.translate("squeezed", _ENDS, _LATE).alias("s")).distinct()
    ordered = once.repartitionByRange(shuffle_partitions(texts.sparkSession), "s").sortWithinPartitions("s", "h")

    def goes_on(a: str, b: str) -> bool:
        return len(b) > len(a) and b.startswith(a) and b[len(a)] not in _LATE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[int] = []
        first = last = None
        for b in batches:
            found: list[int] = []
            for h, s in zip(b["h"].tolist(), b["s"].tolist(), strict=True):
                if s != last:
                    if last is None:
                        first = s
                    elif goes_on(last, s):
                        found += held
                    held = []
                held.append(h)
                last = s
            yield pd.DataFrame({"h": found, "part": None, "first": None, "last": None})
        if last is not None:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"h": held, "part": part, "first": first, "last": last})

    seen = cut(ordered.mapInPandas(run, "h long, part int, first string, last string"))
    # the last value of a range (one row for each text that has it) is compared with the first one of the next range
    edges = seen.where("part is not null")
    ranges = edges.select("part", "first").distinct().withColumn("nx", F.lead("first").over(Window.orderBy("part")))
    following = edges.join(ranges.select("part", "nx"), "part").where(F.startswith("nx", "last") & ~F.expr("substring(nx, length(last) + 1, 1)").isin(*_LATE, ""))
    return seen.where("part is null").select("h").unionAll(following.select("h")).distinct()


def truncated(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """doc_id, source, why (longer copy, structure, sign, limit, words) of every cut text."""
    docs = documents.selectExpr(f"`{key}` as doc_id", f"`{text}` as text", f"coalesce(`{source}`, '') as source").where("text is not null and doc_id is not null")
    all_ends = cut(ends_of(docs))
    ends = all_ends.where("keys is not null")
    wanted = cut(ends.select(F.explode("keys").alias("key")).where("key <> 0").distinct())
    seen = cut(whole_pass(docs, wanted, cut(live_prefixes(all_ends))))
    counted = seen.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.sum("stop").alias("stop"))
    stats = counted.select("key", (F.col("n") - F.col("stop")).alias("go_on"), "stop")
    one = ends.select("doc_id", F.posexplode("keys").alias("k", "key")).where("key <> 0")
    go_on, stop = F.coalesce("go_on", F.lit(0)), F.coalesce("stop", F.lit(0))
    named = [*(f"g{k}" for k in SIZES), "before"]
    known = one.join(stats, "key", "left").groupBy("doc_id").agg(*[F.max(F.when(F.col("k") == i, F.struct(go_on.alias("go_on"), stop.alias("stop")))).alias(n) for i, n in enumerate(named)])

    def share(i: int, least: int) -> Column:  # share of the times that the last i words ended a sentence
        g = F.col(f"g{i}")
        return F.when(g.go_on + g.stop >= least, g.stop / (g.go_on + g.stop))

    ends_here = F.coalesce(share(6, 3), share(4, 3), share(3, 3))
    copies = longer_copies(seen.where("h is not null")).withColumn("copied", F.lit(True))
    full = ends.join(known, "doc_id", "left").join(piles(all_ends), ["source", "len"], "left").join(copies, "h", "left")
    at, body = F.coalesce("at", F.lit(0)), F.col("trailer") == 0
    goes_on = F.coalesce(ends_here < 0.5, F.lit(False)) | (ends_here.isNull() & F.coalesce(share(2, 10) < 0.05, F.lit(False)))
    # a stump is no word of the corpus, or one that never follows the two words before it though these are common
    seen = lambda n: F.col(n).go_on + F.col(n).stop
    stump = F.coalesce(seen("g1") == 0, F.lit(False)) | F.coalesce((F.col("before").go_on >= 10) & (seen("g3") == 0), F.lit(False))
    why = (
        F.when(F.col("copied"), "longer copy")
        .when(F.col("sure"), "structure")
        .when(F.col("sign") == 2, "sign")
        .when((F.col("sign") == 1) & ((at > 0) | goes_on | stump), "sign")
        .when((F.col("sign") == 0) & (at == 2), "limit")
        .when((F.col("sign") == 0) & body & ((at == 1) & (F.coalesce(ends_here, F.lit(0.0)) < 0.9)), "limit")
        .when((F.col("sign") == 0) & body & (goes_on | stump), "words")
    )
    found = cut(full.select("doc_id", "source", "h", why.alias("why")))
    # copies of a cut text are cut too
    cut_texts = found.where("why is not null").groupBy("h").agg(F.min("why").alias("copy_why"))
    return found.join(cut_texts, "h").select("doc_id", "source", F.coalesce("why", "copy_why").alias("why"))
