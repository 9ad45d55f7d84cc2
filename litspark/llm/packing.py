"""Filling containers of fixed capacity with documents (sum-of-squares online packing).

Token counts are taken once with a public tokenizer in Arrow batches (the texts are never shuffled); its rank file is
handed to the workers by Spark.  The narrow rows (document, tokens) are then hashed into buckets, repeated rows each by
themselves, so no bucket grows with a key; each bucket packs its items online into the fill level that minimises
the sum of the squared counts of partly filled containers, kept in one level array of ``capacity`` entries.

Only an item longer than a container is split: into full containers and a remainder that is packed like any other
item.  A bucket holds about ``bucket_rows`` items, whatever the input's size, so the containers left open at its end
are a small share of its containers.

Defined results: null and empty texts have no tokens and are in no container; repeated rows are packed like others;
the result depends on ids and sizes only, not on the order or the partitions of the input.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.session import cut

# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ENCODERS: dict[str, object] = {}


def encoder(ranks_path: str):
    """The tokenizer of a rank file, made once per process."""
    if ranks_path not in _ENCODERS:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks_path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[ranks_path]


def token_counts(df: DataFrame, key: str, text: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """key and n_tokens of each row with a text.  ranks_path: a rank file that the driver can read."""
    df.sparkSession.sparkContext.addFile(ranks_path)
    name = os.path.basename(ranks_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "n_tokens": [len(encode(t)) for t in b["text"]]})

    return df.selectExpr(f"`{key}` as key", f"`{text}` as text").where("text is not null and text <> ''").mapInPandas(run, "key long, n_tokens long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, offset) of each item; sizes are between 1 and capacity, placed online in the order given.

    N(h) is the number of containers filled to h.  Putting an item of size s on level h changes the sum of squares by
    2 (N(h+s) - N(h)) + 2, on a new container by 2 N(s) + 1; a container that gets full leaves the sum.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    container, offset = np.empty(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        best, at = (2 * counts[s] + 1 if s < capacity else 0), 0
        if s < capacity:
            here = counts[1 : capacity - s + 1]
            change = 2 * (counts[s + 1 :] - here) + 2
            change[-1] = 1 - 2 * here[-1]
            change[here == 0] = 1 << 40
            j = int(change.argmin())
            if change[j] <= best:
                at = j + 1
        if at:
            c = open_at[at].pop()
            counts[at] -= 1
        else:
            c, made = made, made + 1
        container[i], offset[i] = c, at
        if at + s < capacity:
            counts[at + s] += 1
            open_at[at + s].append(c)
    return container, offset


def pack(items: DataFrame, capacity: int, bucket_rows: int = 50_000) -> DataFrame:
    """key, part, n_tokens, container, offset_tokens: where each part of each item lies.

    items: key (long, unique or repeated) and n_tokens.  part is 1 for an item that is not split.
    """
    # counted and used again: the tokens are not to be counted twice
    items = cut(items.select("key", "n_tokens").where("key is not null and n_tokens > 0"))
    buckets = max(1, -(-items.count() // bucket_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "key", "n_tokens"], kind="stable")
        bucket, n, key = int(pdf["bucket"].iloc[0]), pdf["n_tokens"].to_numpy(), pdf["key"].to_numpy()
        whole, rest = n // capacity, n % capacity
        whole, rest = np.where((whole > 0) & (n == capacity), 0, whole), np.where(n == capacity, capacity, rest)
        has_rest = rest > 0
        container, offset = sum_of_squares(rest[has_rest], capacity)
        made = int(container.max()) + 1 if len(container) else 0
        out = [pd.DataFrame({"key": key[has_rest], "part": whole[has_rest] + 1, "n_tokens": rest[has_rest], "local": container, "offset_tokens": offset})]
        if whole.any():
            long_key, parts = np.repeat(key, whole), np.concatenate([np.arange(1, w + 1) for w in whole if w])
            out.append(pd.DataFrame({"key": long_key, "part": parts, "n_tokens": capacity, "local": made + np.arange(len(parts)), "offset_tokens": 0}))
        all_ = pd.concat(out)
        all_["container"] = all_["local"] * buckets + bucket
        return all_[["key", "part", "n_tokens", "container", "offset_tokens"]]

    copies = items.groupBy("key", "n_tokens").agg(F.count("*").alias("n")).select("key", "n_tokens", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    hashed = copies.select("key", "n_tokens", F.xxhash64("key", "copy").alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    return hashed.groupBy("bucket").applyInPandas(run, "key long, part long, n_tokens long, container long, offset_tokens long")
