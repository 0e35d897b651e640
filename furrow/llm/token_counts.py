"""Token counts of whole texts: Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that go to the tokenizer at once, and from which on a text is split.
BATCH_BYTES = 1 << 20
SPLIT_BYTES = 1 << 16
#: One space between two ASCII letters or digits.
_SEAM = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def _bytes(text: str) -> int:
    """The size of a text in UTF-8."""
    return len(text) if text.isascii() else len(text.encode())


class Counter:
    """Counts for one vocabulary file: sentencepiece for .model, tokenizers for .json."""

    def __init__(self, path: str):
        self.seams = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            # No piece reaches over a space, and each part gets the leading space mark that the
            # lost space would have given it: parts then count as they do within the text.
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            whole = model.encode("a b c", out_type=str)
            parts = [p for x in ("a", "b", "c") for p in model.encode(x, out_type=str)]
            self.seams = whole == parts and not any(re.search("[^▁]▁", p) for p in pieces)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.lengths = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str]:
        """A long text in parts that count on their own; whole if it has no safe boundary."""
        n_bytes = _bytes(text)
        if not self.seams or n_bytes <= SPLIT_BYTES:
            return [text]
        most = SPLIT_BYTES * len(text) // n_bytes  # characters of a part, at the text's mean size
        out, at = [], 0
        while len(text) - at > most and (seam := _SEAM.search(text, at + most // 2)):
            out.append(text[at : seam.start()])
            at = seam.end()
        return [*out, text[at:]]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; batches are filled by bytes, not by number."""
        total = [0] * len(texts)
        batch: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            for k, n in zip(owner, self.lengths(batch), strict=True):
                total[k] += n
            batch.clear()
            owner.clear()

        for k, text in enumerate(texts):
            for part in self.parts(text):
                batch.append(part)
                owner.append(k)
                size += _bytes(part)
                if size >= BATCH_BYTES:
                    flush()
                    size = 0
        if batch:
            flush()
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One tokenizer per Python worker."""
    return Counter(path)


def n_tokens(text: Column | str, path: str) -> Column:
    """Tokens of a text without added special tokens, as a long; null and empty texts have none.

    Nothing is truncated. Special strings inside a text are handled as the library does by default.
    Repeated rows count alike, however long a text is; an empty table gives no rows; no other column
    is read.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for texts in batches:
            yield pa.array(own.counts([t or "" for t in texts.to_pylist()]), pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)
