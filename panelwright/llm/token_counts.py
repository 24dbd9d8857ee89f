"""Token counts by a two-tier lookup of pre-token lengths, with no shuffle of pre-tokens.

Pre-tokens here are the pieces between ASCII white space, which the tokenizer's own rules never cross. Tier one
is a broadcast table of the lengths of at most ``TABLE`` frequent pieces. It is found by a pass over all
texts in which each task keeps a bounded tally (pieces beyond ``TALLY`` make it forget the rarest) and reports its
``REPORT`` largest counts; only these reports are summed. Tier two encodes the pieces that the table misses, in
batches, and keeps their lengths in a bounded cache of the Python worker. What the table holds changes
the speed, never a count. A text with a special token's string goes through the library whole.

Defined cases: a null or empty text has no tokens; repeated rows are counted alike; very long
texts and pieces are whole (long pieces are not cached); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.line_dedup import raw_texts

TOKENIZER = "word_bpe_49k.json"
TABLE = 32_768
TALLY = 200_000
REPORT = 4_096
CACHE = 200_000
CACHED_BYTES = 64
TEXTS = 512


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceLengths:
    """Lengths of pieces: a fixed table, then a cache, then the library."""

    def __init__(self, file: str, table: dict[bytes, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(str(file))
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.table, self.cache = table, {}

    def whole(self, text: bytes) -> int:
        return len(self.library.encode(text.decode(), add_special_tokens=False).ids)

    def encoded(self, pieces: list[bytes]) -> list[int]:
        found = self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [len(e.ids) for e in found]

    def counts(self, texts: list[bytes]) -> list[int]:
        """Number of tokens of each text."""
        table, cache = self.table, self.cache
        tallies = [None if any(s in t for s in self.specials) else Counter(t.split()) for t in texts]
        missed = list({p for tally in tallies if tally for p in tally if p not in table and p not in cache})
        fresh = dict(zip(missed, self.encoded(missed), strict=True)) if missed else {}
        out = []
        for text, tally in zip(texts, tallies, strict=True):
            if tally is None:
                out.append(self.whole(text))
                continue
            total = 0
            for piece, times in tally.items():
                length = table.get(piece)
                if length is None:
                    length = cache.get(piece)
                    if length is None:
                        length = fresh[piece]
                total += length * times
            out.append(total)
        if len(cache) + len(fresh) > CACHE:
            cache.clear()
        cache.update((p, n) for p, n in fresh.items() if len(p) <= CACHED_BYTES)
        return out


def frequent_pieces(docs: DataFrame, most: int = TABLE) -> list[bytes]:
    """At most ``most`` pieces that are frequent over all texts."""

    def tally(batches):
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in raw_texts(batch.column("text")):
                seen.update(text.split())
                if len(seen) > TALLY:
                    seen = Counter(dict(seen.most_common(TALLY // 4)))
        top = [(p, n) for p, n in seen.most_common(REPORT) if n > 1 and len(p) <= CACHED_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["piece", "times"])

    reports = docs.select("text").mapInArrow(tally, "piece binary, times long")
    top = reports.groupBy("piece").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "piece").limit(most)
    return [bytes(row.piece) for row in top.select("piece").collect()]


def counted(docs: DataFrame, name: str = TOKENIZER, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; the tokenizer is a file of public_tokenizers."""
    spark = docs.sparkSession
    pieces = frequent_pieces(docs)
    lengths = PieceLengths(tokenizer_path(name), {}).encoded(pieces) if pieces else []
    table = spark.sparkContext.broadcast(dict(zip(pieces, lengths, strict=True)))

    def count(batches):
        known = PieceLengths(tokenizer_path(name), table.value)
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            tokens = np.array([n for a in range(0, len(texts), TEXTS) for n in known.counts(texts[a : a + TEXTS])], np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
