"""Token counts with a whole-token shortcut.

Of a byte-level BPE vocabulary most strings that texts use encode alone as one token. Which ones do is proven once, by
encoding every vocabulary string by itself; pre-tokens among them count one without any merging. All others are merged
by the tokenizer, once for each different string while the cache holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import sliced

CACHE_ENTRIES = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenCounter:
    """Counts tokens as the tokenizer does without added special tokens, truncation or padding."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.whole = self._proven(set(added))
        self.cache: dict[str, int] = {}
        self.merges: dict[str, int] = {}
        # Where two regular expression engines may class a character otherwise, the tokenizer counts.
        self.usual = regex.compile(r"[\x09\x0A\x0D\x20-\x7E¡-ͷЀ-ԯ‐-‧€]*").fullmatch

    def _proven(self, added: set[int]) -> set[str]:
        """The vocabulary strings that encode alone as exactly their own token."""
        ids = [i for i in range(self.tokenizer.get_vocab_size()) if i not in added]
        strings = self.tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
        encoded = self.tokenizer.encode_batch(strings, add_special_tokens=False)
        return {s for s, i, e in zip(strings, ids, encoded, strict=True) if e.ids == [i]}

    def _merged(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> int:
        """The tokens of a piece that is cut from its text at pre-token borders."""
        if not self.usual(piece):
            return self._merged(piece)
        total, whole, merges = 0, self.whole, self.merges
        for x in self.split(piece):
            if x in whole:
                total += 1
                continue
            n = merges.get(x)
            if n is None:
                if len(merges) > CACHE_ENTRIES:
                    merges.clear()
                n = self._merged(x)
                if len(x) <= 64:
                    merges[x] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            return self._merged(text)
        # A single space always begins a pre-token, so pieces between single spaces can be counted apart; only in runs
        # of spaces does the last one alone belong to what follows.
        pieces = text.split(" ")
        if "" in pieces[1:]:
            return self._piece(text)
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache, total = self.cache, 0
        head = pieces[0]
        total += self._piece(head) if head else 0
        for piece in pieces[1:]:
            n = cache.get(piece)
            if n is None:
                n = self._piece(" " + piece)
                if len(piece) <= 64:
                    cache[piece] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    Counts equal those of the tokenizer file at `path`, special strings inside a text included (the tokenizer's
    default). Null and empty texts have no bytes and no tokens. Rows are independent: repeated ids are counted each, a
    null id is kept, other columns are not read. An empty table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in sliced(batches):
            ids, sizes, totals = batch.column(0), [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                totals.append(count(text))
            n = pa.array(totals, pa.int64())
            over = pa.array([x > limit for x in totals], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), n, over], names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    names = schema.names
    return rows.mapInArrow(run, schema)
