"""SentencePiece BPE encoding and decoding by a table of last tokens.

Every prefix of a text has one encoding under merge-type BPE, and so one last token: among the vocabulary's tokens that
end there (found by an automaton), the one that is compatible with the last token of the prefix before it. Two tokens
are compatible if encoding their joined text gives the two back. One pass fills the table; the ids are recovered from
the end backwards. The cost is linear in the text, whatever its length.

Texts are cut where no token of the vocabulary reaches across (before a run of blanks, before marks that never follow a
letter inside a token, around line breaks), and the pieces of text between are encoded once per worker and remembered,
within a bound in bytes; long stretches (unspaced texts) aren't remembered. The model file is read by the driver and sent as bytes (half a megabyte, whatever the corpus).

Defined cases: null or empty text has the end id only and decodes to ''; characters that the vocabulary lacks become
their UTF-8 bytes; a literal U+2581 counts as a blank, as in the library; repeated rows and doc_ids are kept; other
columns are ignored.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
#: Bytes of remembered stretches per worker (twice that for a moment's sake: a newer and an older half), letters of a
#: stretch that is remembered, remembered pairs of tokens.
REMEMBERED, LONGEST, PAIRS = 32 << 20, 48, 600_000
#: What a remembered stretch takes besides its letters and ids.
OVERHEAD = 180
ROWS_OUT = 256


class Pieces:
    """The vocabulary, its automaton, and the encoder."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(sp.get_piece_size())
        # blanks are written as plain blanks here, which keeps most texts at a byte a letter
        self.rank = {sp.id_to_piece(i).replace(BLANK, " "): sp.get_score(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.id_of = {p: sp.piece_to_id(p.replace(" ", BLANK)) for p in self.rank}
        self.end = sp.eos_id()
        self.kind = "H" if len(ids) <= 1 << 16 else "I"
        self.byte = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.as_byte = {i: b for b, i in self.byte.items()}
        self.tokens = [p for p in self.rank if self.merged(list(p)) == [p]]  # the others can't come out of merging
        self.tokens += sorted(set("".join(self.tokens)) - self.rank.keys())  # letters that only occur inside tokens
        self.automaton = ahocorasick.Automaton()
        self.single = {p: k for k, p in enumerate(self.tokens) if len(p) == 1}  # ends every prefix that no longer token ends
        for k, p in enumerate(self.tokens):
            if len(p) > 1:
                self.automaton.add_word(p, (k, len(p) - 1))
        self.automaton.make_automaton()
        self.text_of = {i: p for p, i in self.id_of.items()} | {self.end: ""}
        self.fits: dict[int, bool] = {}
        self.cut = re.compile(self._cut())

    def merged(self, parts: list[str]) -> list[str]:
        """Plain merging, best score first, leftmost on ties; for tokens and pairs of tokens only."""
        rank = self.rank
        while len(parts) > 1:
            scores = [rank.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [s for s in scores if s is not None]
            if not known:
                break
            k = scores.index(max(known))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _cut(self) -> str:
        """A pattern for stretches that no token reaches beyond."""
        marks = set(".,;:!?")
        while bad := {b for p in self.tokens for a, b in zip(p, p[1:]) if b in marks and a not in marks and a != " "}:
            marks -= bad
        blanks = not any(b == " " and a != " " for p in self.tokens for a, b in zip(p, p[1:]))
        m = re.escape("".join(sorted(marks)))
        out = "\n" if not any("\n" in p for p in self.tokens) else ""
        if not blanks:
            return rf"[^{out}]+|\n" if out else r"(?s).+"
        head = rf"(?: +[{m}]*|[{m}]+)[^ {m}{out}]*" if m else rf" +[^ {out}]*"
        return rf"{head}|[^ {m}{out}]+" + ("|\n" if out else "")

    def compatible(self, a: int, b: int) -> bool:
        x, y = self.tokens[a], self.tokens[b]
        if len(self.fits) > PAIRS:
            self.fits.clear()
        ok = self.fits[a << 20 | b] = self.merged(list(x + y)) == [x, y]
        return ok

    def ids(self, text: str) -> list[int]:
        """Ids of one stretch."""
        single, fits, done = self.single, self.fits, 0
        last = [-1, *[single.get(c, -1) for c in text]]  # -1: the start, or a letter of no token
        for at, (k, n) in self.automaton.iter(text):
            if at != done:
                before = last[at - n]
                if before < 0:
                    last[at + 1], done = k, at
                else:
                    ok = fits.get(before << 20 | k)
                    if ok or ok is None and self.compatible(before, k):
                        last[at + 1], done = k, at
        out, at = [], len(text)
        while at:
            token = self.tokens[last[at]] if last[at] >= 0 else text[at - 1]
            if (i := self.id_of.get(token)) is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in reversed(token.encode())]
            at -= len(token)
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes are joined to letters, an end id is nothing. The leading blank stays."""
        try:
            return "".join(map(self.text_of.__getitem__, ids))
        except KeyError:
            return b"".join([bytes([self.as_byte[i]]) if i in self.as_byte else self.text_of.get(i, "").encode() for i in ids]).decode("utf-8", "replace")


class Remembered(dict):
    """stretch -> its ids, packed; what is met twice is remembered, the older half is dropped when REMEMBERED bytes are full."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.old, self.held = pieces, {}, 0
        self.met, self.new = bytearray(1 << 20), 0

    def __missing__(self, stretch: str) -> bytes:
        got = self.old.get(stretch)
        if got is None:
            got = array(self.pieces.kind, self.pieces.ids(stretch)).tobytes()
            at = hash(stretch) & 0xFFFFF
            if not self.met[at] or len(stretch) > LONGEST:
                self.met[at] = 1
                self.new += 1
                if self.new > 1 << 19:
                    self.met, self.new = bytearray(1 << 20), 0
                return got
        self.held += OVERHEAD + len(stretch) * (1 if stretch.isascii() else 4) + len(got)
        if self.held > REMEMBERED:
            self.old, self.held = dict(self), 0
            self.clear()
        self[stretch] = got
        return got


_LOADED: dict[int, Remembered] = {}


def _loaded(proto: bytes) -> Remembered:
    if (key := hash(proto)) not in _LOADED:
        _LOADED[key] = Remembered(Pieces(proto))
    return _LOADED[key]


def encode_text(memory: Remembered, text: str | None) -> tuple[array, str]:
    """(ids with the end id, decoded text)."""
    ids = array(memory.pieces.kind)
    if text:
        ids.frombytes(b"".join(map(memory.__getitem__, memory.pieces.cut.findall(" " + text.replace(BLANK, " ")))))
    decoded = memory.pieces.decode(ids)[1:]
    ids.append(memory.pieces.end)
    return ids, decoded


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of int, end id included), decoded, for every row of docs (doc_id, text)."""
    with open(model or public_tokenizers.path(MODEL), "rb") as f:
        proto = f.read()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        memory = _loaded(proto)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(k, ROWS_OUT)
                rows = [encode_text(memory, t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0] + [len(r[0]) for r in rows], dtype=np.int32)
                flat = np.concatenate([np.frombuffer(r[0], r[0].typecode) for r in rows]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
