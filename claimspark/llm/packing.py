"""Hierarchical multi-length packing of token sequences.

A document's tokens are the ids of a public byte-level BPE vocabulary and a
closing id.  Whole windows of the longest tier are cut off a long document;
what remains is routed to the smallest tier (context size) that holds it.
Tiers are packed from the longest down: the routed piece opens a window and
its gap is filled with the largest shorter pieces that fit, best fit first,
and when none fits a shorter piece is cut to fill it exactly.  When a task
has no piece left for a gap, the last window is cut into sequences of
power-of-two lengths.  Tier lengths are powers of two, so no sequence needs
padding.  Sequences are dealt to step groups, longest first, each to the
group with the fewest tokens.

Each task packs its own rows in blocks of ``block_tokens``; pieces left over
go to the next block, so memory is bounded by a block and the longest text,
and no row is shuffled.  The order inside a task is the input's; sequence ids
carry the partition number in their upper bits and are gapless inside it.

Edge cases: null and empty texts are one closing token; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, sequence_tokens bigint, step_group bigint")


#: Runs of white space from which on the vocabulary's JSON form encodes: the
#: rank file's pattern overflows its stack on runs of a million blanks.
LONG_BLANKS = re.compile(r"\s{10000}")


@lru_cache(maxsize=2)
def encoder(rank_file: str):
    """Text to ids by the byte-level BPE vocabulary read from its rank file.
    It gives the same ids as the vocabulary's JSON form beside it (a test
    compares the two) in a fifth of the time; texts with a long run of white
    space are left to the JSON form."""
    import public_tokenizers
    import tiktoken
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) >= 10_000 and LONG_BLANKS.search(text):
            return whole_encoder(rank_file).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


@lru_cache(maxsize=2)
def whole_encoder(rank_file: str):
    """The vocabulary's JSON form, its added tokens read as plain text."""
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(rank_file.removesuffix(".tiktoken") + ".json")
    found.encode_special_tokens = True
    return found


class Packer:
    """Packs (doc, start, length) pieces of one task."""

    def __init__(self, tiers: tuple[int, ...], group_tokens: int, first_id: int):
        self.tiers, self.longest = sorted(tiers), max(tiers)
        self.group_tokens = group_tokens
        self.next_sequence = self.next_group = first_id
        self.pools: dict[int, list] = {t: [] for t in self.tiers}  # per tier: (length, order, doc, start)
        self.order = 0
        self.sequences: list[list] = []  # packed pieces, not yet handed out

    def add(self, doc: int, length: int) -> None:
        """Cut whole windows off the front and route the rest."""
        start = 0
        while length - start >= self.longest:
            self.sequences.append([(doc, start, self.longest)])
            start += self.longest
        self._route(doc, start, length - start)

    def _route(self, doc: int, start: int, length: int) -> None:
        if length:
            tier = next(t for t in self.tiers if t >= length)
            self.order += 1
            insort(self.pools[tier], (length, self.order, doc, start))

    def _largest(self, gap: int):
        """The largest piece of at most ``gap`` tokens, from any tier."""
        best = None
        for pool in self.pools.values():
            at = bisect_right(pool, (gap, float("inf")))
            if at and (best is None or pool[at - 1][0] > best[0][at_best][0]):
                best, at_best = (pool,), at - 1
        return best[0].pop(at_best) if best else None

    def pack(self, last: bool) -> None:
        """Open a window for each routed piece, longest tier first.  Without
        ``last`` a window that finds no filler goes back to the pools."""
        for tier in reversed(self.tiers):
            pool = self.pools[tier]
            while pool:
                window, gap = [], tier
                piece = pool.pop()
                while piece:
                    length, _, doc, start = piece
                    take = min(length, gap)
                    window.append((doc, start, take))
                    self._route(doc, start + take, length - take)
                    gap -= take
                    if not gap:
                        break
                    piece = self._largest(gap) or next((p.pop(0) for p in self.pools.values() if p), None)
                if gap and not last:
                    for doc, start, length in window:
                        self._route(doc, start, length)
                    return
                if gap:
                    self._powers(window)
                else:
                    self.sequences.append(window)

    def _powers(self, window: list) -> None:
        """Cut the last window into sequences of power-of-two lengths."""
        total = sum(w[2] for w in window)
        for bit in reversed(range(total.bit_length())):
            size, part = 1 << bit, []
            if not total & size:
                continue
            while size:
                doc, start, length = window.pop(0)
                take = min(size, length)
                part.append((doc, start, take))
                size -= take
                if length > take:
                    window.insert(0, (doc, start + take, length - take))
            self.sequences.append(part)

    def take(self) -> list[tuple]:
        """The packed sequences as (sequence id, tokens, step group, pieces)."""
        sized = sorted(((sum(p[2] for p in s), s) for s in self.sequences), key=lambda x: -x[0])
        self.sequences = []
        n = max(1, round(sum(t for t, _ in sized) / self.group_tokens))
        heap = [(0, self.next_group + g) for g in range(n)]
        out = []
        for tokens, pieces in sized:
            load, group = heap[0]
            heapq.heapreplace(heap, (load + tokens, group))
            out.append((self.next_sequence, tokens, group, pieces))
            self.next_sequence += 1
        self.next_group += n if out else 0
        return out


def pack_documents(docs: DataFrame, rank_file: str, tiers: tuple[int, ...] = (256, 512, 1024, 2048),
                   closing_id: int = 1, block_tokens: int = 1 << 20, group_tokens: int = 1 << 17) -> DataFrame:
    """One row per piece, see ``SCHEMA``."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(rank_file)
        packer = Packer(tiers, group_tokens, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        held: dict[int, tuple] = {}  # documents with pieces not handed out: (doc_id, ids, tokens left)
        count = waiting = 0

        def flush(last: bool) -> pd.DataFrame:
            packer.pack(last)
            rows = []
            for sequence, tokens, group, pieces in packer.take():
                offset = 0
                for doc, start, length in pieces:
                    doc_id, ids, left = held[doc]
                    crc = zlib.crc32(ids[start:start + length].tobytes())
                    rows.append((doc_id, start, length, crc, len(ids), sequence, offset, tokens, group))
                    offset += length
                    if left == length:
                        del held[doc]
                    else:
                        held[doc] = (doc_id, ids, left - length)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            return out.astype({c: "int64" for c in out.columns if c != "doc_id"}).astype({"doc_id": "Int64"})

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"]):
                ids = np.array(encode(text or "") + [closing_id], "<u4")
                held[count] = (None if pd.isna(doc_id) else int(doc_id), ids, len(ids))
                packer.add(count, len(ids))
                count += 1
                waiting += len(ids)
                if waiting >= block_tokens:
                    yield flush(False)
                    waiting = 0
        yield flush(True)

    return docs.select("doc_id", "text").mapInPandas(pack, SCHEMA)
