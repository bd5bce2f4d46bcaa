"""Token counts and token ids with a public tokenizer, in Arrow batches.

Texts are cut at safe boundaries, where no token can reach across, and each
distinct piece is encoded once per worker while a bounded memo holds it:

* sentencepiece BPE: before a single space between two other characters.  The
  library puts a space mark before every text it is given, so the part after the
  boundary, given without its space, gets the same pieces.  This needs a model with
  that dummy prefix, no removal of spaces, no character normalisation and no piece
  with a space mark after another character; ``piece_boundaries_hold`` checks the
  pieces and the rest by encoding probes, and a model that fails is encoded whole.
* tokenizers BPE that drops white space: at ASCII white space.

Nothing is truncated, padded or added; special strings inside a text are handled as
each library does by default.  Null text counts as empty: 0 tokens.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, need

ENCODE_BYTES = 1 << 20
MEMO_PIECES = 400_000
MARK = "\u2581"
#: A single space between two characters that are neither spaces nor the space mark.
BOUNDARY = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")

_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a file, once per worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def piece_boundaries_hold(model) -> bool:
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        return False
    a, b = "xﬁY", "z  w "
    return model.encode(f"{a} {b}") == model.encode(a) + model.encode(b)


def pieces_of(text: str) -> list[str]:
    """The text cut at its safe boundaries, without the boundary spaces."""
    if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
        return BOUNDARY.split(text)
    return text.split(" ")


class PieceLengths:
    """Token counts of texts under a sentencepiece model."""

    def __init__(self, path: str):
        self.model = load(path)
        self.cut = pieces_of if piece_boundaries_hold(self.model) else lambda t: [t]
        self.memo: dict[str, int] = {"": 0}

    def __call__(self, texts: list[str]) -> list[int]:
        pieces = [self.cut(t) for t in texts]
        seen = set().union(*pieces)
        new = list(seen.difference(self.memo))
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo, new = {"": 0}, list(seen - {""})
        for i, j in by_bytes([len(p) for p in new], ENCODE_BYTES):
            for p, ids in zip(new[i:j], self.model.encode(new[i:j], num_threads=1), strict=True):
                self.memo[p] = len(ids)
        get = self.memo.__getitem__
        return [sum(map(get, x)) for x in pieces]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = PieceLengths(model_path)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            n_bytes = [len(t.encode()) for t in texts]
            n_tokens: list[int] = []
            for i, j in by_bytes(n_bytes, 4 * ENCODE_BYTES):
                n_tokens += lengths(texts[i:j])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


#: Letters that stand alone under NFC and change case one to one, then marks that form one run.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:#$%&*|]*)")


def byte_symbols() -> str:
    """The character that byte-level BPE writes for each byte: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


class WordIds(dict):
    """Token ids, as little-endian uint32 bytes, of texts under a lower-casing tokenizer that drops white space.

    Words of Latin letters and marks go to the BPE model at once, as what
    comes before it leaves them as they are but for case; all others take the whole
    way.  A dict from word to ids that holds ``MEMO_PIECES`` words at most.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        probes = ("Éàü,".encode(), b"Some!!", b"WORD", "ñandú***".encode())
        if not all(self.whole(w) == self.short(*PLAIN.fullmatch(w.decode()).groups()) for w in probes):
            raise ValueError(f"{path} is not a lower-casing byte-level BPE that drops white space")

    def whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def short(self, *runs: str) -> bytes:
        ids = [t.id for r in runs if r for t in
               self.model.tokenize(r.lower().encode().decode("latin-1").translate(self.symbols))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # of ASCII letters
            ids = [t.id for t in self.model.tokenize(word.lower().decode())]
            out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            runs = PLAIN.fullmatch(word.decode())
            out = self.short(*runs.groups()) if runs else self.whole(word)
        if len(self) < MEMO_PIECES:
            self[word] = out
        return out

    def __call__(self, text: bytes) -> bytes:
        # special strings are matched before letters change case
        low = text if b"<|" in text else text.lower()
        return b"".join(map(self.__getitem__, low.split()))
