"""Mapping typed names to a reference list: token-level repair, then soft TF-IDF over complete entries.

Typed names are reduced to their distinct spellings and cut into units: words, runs of adjacent words, and codes
(windows of adjacent pieces with digits, Greek letters or short letter groups).  Each distinct word that is not in the
reference vocabulary is joined to it by edit distance (adjacent swaps count once): a segment index over the vocabulary
gives the candidates, all of which are measured, and the nearest words of the whole vocabulary count, all of them on a
tie.  Codes are never repaired: a code with another number is another product.
Corrected units then vote for complete entries with soft TF-IDF, and the best entry must name one program.

Scale: names collapse to distinct spellings before any work, so a name that fills a third of all rows costs one row;
the way back to the rows is a salted join.  Units that are words of the vocabulary are set aside by a join first.  The
rest meets the vocabulary in a cogroup of token buckets and vocabulary groups, so neither the driver nor a task holds
more than ``vocab_group`` words; the nearest words are taken over all groups.  Everything else is an equi-join.

Defined results: null and blank names give no row; a name that fits no entry, or entries of several programs, or an
entry marked ambiguous, gives ``NONE``; repeated reference rows count once; an empty reference list gives ``NONE``.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.session import cut, shuffle_partitions

NONE = "NONE"
# Greek letters that are also written out.
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "kappa": "κ", "lambda": "λ", "sigma": "σ", "omega": "ω"}
_GREEK = re.compile("|".join(GREEK))
_MARKS = re.compile(r"[®™©℠]|\((?:tm|r|c|sm)\)", re.IGNORECASE)
_DOSE = re.compile(r"\d+(?:\.\d+)?\s*[x×]\s*10\s*\^?\s*\d+(?:\s*(?:pfu|vp|vg|tcid50|cfu|iu|particles|cells))?|\b\d+(?:\.\d+)?\s*(?:mg|ml|µg|μg|ug|pfu|vp|vg|iu)\b", re.IGNORECASE)
_PIECE = re.compile(r"[^\W_]+")
MIN_WORD = 5


def cleaned(name: str) -> str:
    """One form of case, width, marks, Greek letters and doses."""
    text = _MARKS.sub(" ", unicodedata.normalize("NFKC", _MARKS.sub(" ", name).replace("∆", "Δ"))).lower()
    return _DOSE.sub(" ", text)


def pieces(name: str) -> list[tuple[str, bool]]:
    """(piece, glued to the piece before it), with letters that were typed for digits put right."""
    out, end = [], 0
    text = cleaned(name)
    for m in _PIECE.finditer(text):
        glue = bool(out) and not re.search(r"\s", text[end : m.start()]) and len(text[end : m.start()]) == 1
        piece = m.group()
        if piece in GREEK:
            piece = GREEK[piece]
        if any(c.isdigit() for c in piece):
            piece = re.sub(r"(?<=\d)o(?=\d|$)|(?<=^)o(?=\d)", "0", piece)
            piece = re.sub(r"(?<=\d)[il](?=\d)", "1", piece)
        out.append((piece, glue))
        end = m.end()
    return out


def compact(name: str) -> str:
    """All pieces of a name in one."""
    return "".join(p for p, _ in pieces(name))


def is_code(unit: str) -> bool:
    """Units with digits or other than Latin letters, and short ones, are compared as they are."""
    return len(unit) < MIN_WORD or not unit.isascii() or not unit.isalpha()


def units(name: str, longest: int = 3) -> list[str]:
    """Words, runs of words and codes of a typed name, and the whole of it however many pieces it has.

    longest: pieces of the longest entry that is one unit; codes may be typed in twice as many.
    """
    ps = pieces(name)
    found: dict[str, None] = {"".join(p for p, _ in ps): None} if ps else {}
    for i in range(len(ps)):
        for j in range(i + 1, min(len(ps), i + max(6, 2 * longest)) + 1):
            unit = "".join(p for p, _ in ps[i:j])
            if any(c.isdigit() for c in unit):
                # a number glued on at either side makes it another code
                after = j < len(ps) and ps[j][1] and ps[j][0][:1].isdigit()
                before = i > 0 and ps[i][1] and ps[i - 1][0][-1:].isdigit() and ps[i][0][:1].isdigit()
                if after or before:
                    continue
            if j - i <= max(3, longest) or is_code(unit):
                found[unit] = None
    return list(found)


def allowance(length: int) -> int:
    """Edits that a word of this length may differ by."""
    return 0 if length < 6 else 1 if length < 9 else 2 if length < 14 else 3 if length < 20 else 4


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (an adjacent swap is one edit), or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most and (not before or min(prev) > most):
            return most + 1
        before, prev = prev, row
    return prev[-1]


def _segments(length: int) -> list[tuple[int, int]]:
    """(start, end) of the segments of a word, in two cuts that lie half a segment apart.

    An edit spoils one segment of each cut; a swap at the border of one cut spoils two there but only one in the other.
    With one segment more than edits allowed (two more from three edits on), at least one segment stays whole.
    """
    most = allowance(length)
    n = most + 1 if most < 3 else most + 2
    cuts = [round(i * length / n) for i in range(n + 1)]
    later = [0, *(round((i + 0.5) * length / n) for i in range(n)), length]
    return [p for c in (cuts, later) for p in zip(c[:-1], c[1:], strict=True) if p[0] < p[1]]


def _letters(word: str) -> int:
    """The letters that occur in a word, as a set of bits."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 31)
    return bits


class Vocabulary:
    """Segment index over the words of a reference list."""

    def __init__(self, words: list[str]) -> None:
        self.words = set(words)
        self.letters = {w: _letters(w) for w in self.words}
        self.index: dict[tuple[int, int, str], list[str]] = {}
        self.lengths: set[int] = set()
        for w in sorted(self.words):
            self.lengths.add(len(w))
            for s, e in _segments(len(w)):
                self.index.setdefault((len(w), s, w[s:e]), []).append(w)

    def nearest(self, token: str) -> list[tuple[str, int]]:
        """The reference words nearest to a token within the allowance, all of them on a tie."""
        if token in self.words:
            return [(token, 0)]
        mine, own, seen = _letters(token), allowance(len(token)), set()
        best, found = own, []
        for length in range(len(token) - own, len(token) + own + 1):
            if length not in self.lengths:
                continue
            most = min(allowance(length), own)
            if not most or abs(length - len(token)) > most:
                continue
            for s, e in _segments(length):
                for shift in range(-allowance(length), allowance(length) + 1):
                    for w in self.index.get((length, s, token[s + shift : e + shift]), ()) if s + shift >= 0 else ():
                        if w in seen:
                            continue
                        seen.add(w)
                        # an edit changes which letters occur by two at most
                        least = min(most, best)
                        if (mine ^ self.letters[w]).bit_count() <= 2 * least and (d := edits(token, w, least)) <= least:
                            if d < best:
                                best, found = d, []
                            found.append((w, d))
        return [(w, d) for w, d in found if d == best]


def map_names(names: DataFrame, row_id: str, typed: str, reference: DataFrame, entry_id: str, entry: str, ambiguous: str, vocab_group: int = 50_000, token_bucket: int = 200_000, accept: float = 0.8, salts: int = 8) -> DataFrame:
    """row_id and the entry's id (or NONE) of each name that is not blank; score of the match."""
    rows = names.selectExpr(f"`{row_id}` as row_id", f"`{typed}` as typed").where(F.col("typed").rlike(r"(?U)[^\s​﻿]"))
    spell = rows.select("typed").distinct()

    @F.pandas_udf("int")
    def size_of(s: pd.Series) -> pd.Series:
        return s.map(lambda name: len(pieces(name)))

    @F.pandas_udf("string")
    def key_of(s: pd.Series) -> pd.Series:
        return s.map(compact)

    @F.pandas_udf("array<string>")
    def words_of(s: pd.Series) -> pd.Series:
        # a name of several words, each long enough, is an entry of its words; anything else is one unit
        def split(name: str) -> list[str]:
            ps = [p for p, _ in pieces(name)]
            return sorted(set(ps)) if len(ps) > 1 and not any(is_code(p) for p in ps) else ["".join(ps)]

        return s.map(split)

    ref = reference.selectExpr(f"`{entry_id}` as entry_id", f"`{entry}` as entry", f"coalesce(`{ambiguous}`, 0) as amb").where("entry_id is not null and entry is not null").distinct()
    # the reference and the units are read several times below
    keyed = cut(ref.select("entry_id", "amb", key_of("entry").alias("key"), words_of("entry").alias("words"), size_of("entry").alias("n")).where("key <> ''"))
    longest = keyed.agg(F.max(F.when(F.size("words") == 1, F.col("n")))).head()[0] or 1

    @F.pandas_udf("array<string>")
    def unit_list(s: pd.Series) -> pd.Series:
        return s.map(lambda name: units(name, longest))

    # complete entries: by key, which programs it may mean; as one unit, and as its words where it has several
    entries = keyed.groupBy("key").agg(F.min("entry_id").alias("entry_id"), F.countDistinct("entry_id").alias("n_ids"), F.max("amb").alias("amb"), F.first("words").alias("words"))
    forms = entries.select("key", F.array("key").alias("toks")).unionByName(entries.where("size(words) > 1").select("key", F.col("words").alias("toks")))
    form_tokens = forms.select("key", F.size("toks").alias("form"), F.explode("toks").alias("tok"))
    df = form_tokens.groupBy("tok").agg(F.countDistinct("key").alias("df"))
    n_entries = entries.count()
    weighted = form_tokens.join(df, "tok").withColumn("w", F.log1p(F.lit(float(max(1, n_entries))) / F.col("df")))
    totals = weighted.groupBy("key", "form").agg(F.sum("w").alias("total"))

    # an explicit number of partitions: the work per row is large, so small tables must be spread too
    spread = shuffle_partitions(names.sparkSession)
    unit_rows = cut(spell.repartition(spread).select("typed", F.explode(unit_list("typed")).alias("unit")))
    vocab = cut(form_tokens.select("tok").distinct())
    tokens = unit_rows.select("unit").distinct()
    exact = tokens.join(vocab, tokens.unit == vocab.tok, "left_semi").select("unit", F.col("unit").alias("tok"), F.lit(1.0).alias("sim"))
    is_word = F.col("w").rlike("^[a-z]+$") & (F.length("w") >= MIN_WORD)
    known = cut(vocab.select(F.col("tok").alias("w")).where(is_word))
    unknown = cut(tokens.select(F.col("unit").alias("w")).where(is_word).join(known, "w", "left_anti"))
    groups, buckets = max(1, -(-known.count() // vocab_group)), max(3 * spread, -(-unknown.count() // token_bucket))
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    in_group = lambda n: F.pmod(F.xxhash64("w"), F.lit(n)).cast("int")
    bucketed = unknown.select("w", F.explode(number(groups)).alias("g"), in_group(buckets).alias("b"))
    grouped = known.select("w", in_group(groups).alias("g"), F.explode(number(buckets)).alias("b"))
    # partitions of a stated number are not put together again, so that small tables stay spread
    parts = max(spread, groups * buckets // 3)
    sides = [df.repartition(parts, "g", "b").groupBy("g", "b") for df in (bucketed, grouped)]

    def repair(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index = Vocabulary(right["w"].tolist())
        return pd.DataFrame([(u, w, d) for u in left["w"] for w, d in index.nearest(u)], columns=["unit", "tok", "d"])

    repaired = cut(sides[0].cogroup(sides[1]).applyInPandas(repair, "unit string, tok string, d int"))
    # the nearest over all groups of the vocabulary
    least = repaired.groupBy("unit").agg(F.min("d").alias("least"))
    sim = 1 - F.col("d") / F.greatest(F.length("unit"), F.length("tok"))
    matches = exact.unionByName(repaired.join(least, "unit").where("d = least").select("unit", "tok", sim.alias("sim")))
    best_sim = unit_rows.join(matches, "unit").groupBy("typed", "tok").agg(F.max("sim").alias("sim"))
    votes = best_sim.join(weighted, "tok").groupBy("typed", "key", "form").agg(F.sum(F.col("w") * F.col("sim")).alias("got"), F.count("*").alias("n"))
    scored = votes.join(totals, ["key", "form"]).where(F.col("n") == F.col("form")).withColumn("score", F.round(F.col("got") / F.col("total"), 6)).where(F.col("score") >= accept)
    # the best entry: highest score, then the longest name; several programs at the top fit none
    ranked = cut(scored).join(entries.drop("words"), "key").withColumn("rank", F.struct("score", F.length("key").alias("len")))
    top = ranked.groupBy("typed").agg(F.max("rank").alias("top"))
    won = ranked.join(top, "typed").where(F.col("rank") == F.col("top")).groupBy("typed").agg(
        F.min("entry_id").alias("entry_id"), F.countDistinct("entry_id").alias("n"), F.max("n_ids").alias("n_ids"), F.max("amb").alias("amb"), F.max("score").alias("score")
    )
    one = (F.col("n") == 1) & (F.col("n_ids") == 1) & (F.col("amb") == 0)
    mapping = won.select(F.col("typed").alias("m_typed"), F.when(one, F.col("entry_id")).otherwise(NONE).alias("entry_id"), "score")
    # frequent names are spread over salts
    salted = mapping.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed_rows = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    joined = keyed_rows.join(salted, (F.col("typed") == F.col("m_typed")) & (keyed_rows.salt == salted.salt), "left")
    return joined.select("row_id", "typed", F.coalesce("entry_id", F.lit(NONE)).alias("entry_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
