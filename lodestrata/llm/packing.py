"""Packing of tokenised documents into fixed-length sequences.

Documents are dealt at random (by a hash of their key) to tasks, and a task
packs them in groups of bounded size, each group on its own. Within a group a
document longer than a sequence gives whole sequences first; the rests are
placed by first-fit decreasing, where a tournament tree over the bins' free
capacities finds the leftmost bin that still fits in logarithmic time. As
documents may be cut freely, the emptiest bins are then cut up to fill the gaps
of the others, and what is left over ends in one sequence, which is itself cut
at powers of two if that wastes less.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import only
from ._text import row_runs

#: A group closes at whichever comes first.
GROUP_TOKENS, GROUP_DOCS = 2_000_000, 8192
#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TournamentTree:
    """Free capacities of bins; each inner node holds the larger of its two children."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts size into the leftmost bin that fits it and returns that bin."""
        best, k = self.best, 1
        while k < self.leaves:
            k *= 2
            if best[k] < size:
                k += 1
        best[k] -= size
        found = k - self.leaves
        while k > 1:
            k //= 2
            most = best[2 * k] if best[2 * k] >= best[2 * k + 1] else best[2 * k + 1]
            if best[k] == most:
                break
            best[k] = most
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into sizes; equal sizes keep their order."""
    tree, bins = TournamentTree(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = tree.place(sizes[i])
        if k == len(bins):
            bins.append([])
        bins[k].append(i)
    return bins


def _cost(n: int, capacity: int) -> int:
    """Padding of a sequence of n tokens: none at the full length or a power of two."""
    return 0 if n == 0 or n == capacity or n & (n - 1) == 0 else capacity - n


def pack_group(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length), every token of every document in exactly one piece."""
    done: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths):
        whole = n // capacity
        done += [[(i, k * capacity, capacity)] for k in range(whole)]
        if n > whole * capacity:
            rest.append((i, whole * capacity, n - whole * capacity))
    bins = [[rest[j] for j in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    open_bins: list[tuple[int, list[tuple[int, int, int]]]] = []
    for b in bins:
        n = sum(p[2] for p in b)
        if _cost(n, capacity) == 0:
            done.append(b)
        else:
            open_bins.append((n, b))
    open_bins.sort(key=lambda x: -x[0])
    lo, hi = 0, len(open_bins) - 1
    spare: list[tuple[int, int, int]] = []  # pieces of emptied bins that are still to be placed
    while lo <= hi or spare:
        if lo > hi:
            break
        n, b = open_bins[lo]
        lo += 1
        b = list(b)
        while n < capacity and (spare or lo <= hi):
            if not spare:
                spare = list(reversed(open_bins[hi][1]))
                hi -= 1
            i, s, m = spare.pop()
            take = min(m, capacity - n)
            b.append((i, s, take))
            n += take
            if take < m:
                spare.append((i, s + take, m - take))
        if n == capacity or spare or lo <= hi:
            done.append(b)
        else:
            spare = list(reversed(b))
            break
    # at most one bin's worth, and pieces that found no gap
    while spare:
        left = sum(p[2] for p in spare)
        size = capacity if left >= capacity else left if _cost(left, capacity) == 0 else 1 << (left.bit_length() - 1)
        b = []
        while size:
            i, s, m = spare.pop()
            take = min(m, size)
            b.append((i, s, take))
            size -= take
            if take < m:
                spare.append((i, s + take, m - take))
        done.append(b)
    return done


class ByteBpe:
    """Ids of a byte-level BPE tokenizers file, as bytes of little-endian 32-bit numbers.

    The vocabulary is read from that file and run by tiktoken's encoder, whose
    ids are the same and come several times faster; texts that hold a special
    string, or a run of white space that its pattern engine can't hold, go
    through the tokenizers library itself. A file of another kind is refused.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        told = json.loads(self.tok.to_str())
        model, before = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]] if plain else []
        if not (plain and byte_level and told["normalizer"] is None and made == sorted(made)):
            raise ValueError(f"{path} is no plain byte-level BPE file whose ids are in the order of its merges")
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.odd = re.compile("|".join([*map(re.escape, added), r"\s{5000}"]))
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in self.tok.get_vocab(with_added_tokens=False).items() if piece not in added}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.tok.encode(t, add_special_tokens=False).ids if self.odd.search(t) else self.fast.encode_ordinary(t)).tobytes() for t in texts]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the others from 256 on."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(path)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (the tokens).

    Null and empty texts are the end token alone. A long text is held whole with its
    tokens, and cut into full sequences. Keys are longs, or cast to them. Rows with equal keys are
    documents of their own. A null key stays null. An empty table gives none.
    Only key and text are read, so further columns never clash. Sequence ids are
    unique over the table: the task's number in the upper bits, a counter below.
    A task sorts its documents before it groups them, so one that runs again packs
    as it did; equal rows are dealt apart by the input partition they come from.
    """
    src = only(docs, key=key, text=text).select(F.col("key").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    deal = F.xxhash64("doc_id", "text", F.spark_partition_id())
    src = src.repartition(partitions, deal) if partitions else src.repartition(deal)
    src = src.sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_file)
        base = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4").tobytes()
        group: list[tuple[int | None, bytes]] = []
        held = serial = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal serial, held
            cols: list[list] = [[] for _ in range(8)]
            for seq in pack_group([len(b) // 4 for _, b in group], capacity):
                offset = 0
                for i, s, n in seq:
                    d, b = group[i]
                    ids = b[4 * s : 4 * (s + n)]
                    for c, v in zip(cols, (d, s, n, zlib.crc32(ids), len(b) // 4, base + serial, offset, ids), strict=True):
                        c.append(v)
                    offset += n
                serial += 1
            group.clear()
            held = 0
            for at in range(0, len(cols[0]), 4096):
                yield pa.RecordBatch.from_arrays([*[pa.array(c[at : at + 4096], pa.int64()) for c in cols[:7]], pa.array(cols[7][at : at + 4096], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            for lo, hi in row_runs(texts, 1 << 20):
                for d, ids in zip(keys[lo:hi], enc.encode(texts.slice(lo, hi - lo).to_pylist()), strict=True):
                    group.append((d, ids + end))
                    held += len(ids) // 4 + 1
                    if held >= GROUP_TOKENS or len(group) >= GROUP_DOCS:
                        yield from close()
        if group:
            yield from close()

    return src.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
