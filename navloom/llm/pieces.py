"""SentencePiece encoding and decoding (merge type), exact, by backtracking over longest matches.

A sequence of pieces is the merge encoding of a text if and only if every two neighbours are what merging their joined text
alone gives. So the encoder walks through the text, takes the longest piece that an Aho-Corasick automaton finds and that fits
its left neighbour, and steps back when none does. The encoding of every prefix is unique; hence a position from which there
was no way on never has to be tried again, and a bitfield of such positions keeps the work linear even for texts without
any space. Pieces never hold a space mark after another character, so a text falls apart into independent chunks before each
run of space marks and after runs of letters and digits; chunks repeat and are kept in a bounded cache for each task.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import bounded_batches

SPACE = "▁"
#: Longest chunk that goes to the cache, and how many chunks each of its two generations holds.
_CACHED_CHARS, _CACHED_CHUNKS = 48, 120_000
#: Pairs of pieces whose fit is remembered.
_KNOWN_PAIRS = 100_000
#: Characters of chunks that one scan goes through, and what stands between them: no piece holds it.
_SCANNED_CHARS, _BETWEEN = 100_000, "\0"


def _cutter(pieces) -> re.Pattern:
    """A pattern of chunks between which no merge can happen, because no piece holds the two characters side by side.

    A chunk starts at a run of space marks, or where something else follows a run of letters and digits. Letters and digits
    that do stand before something else in a piece count as something else; single ASCII characters that only ever stand alone
    are chunks of their own.
    """
    pairs = {(a, b) for piece in pieces for a, b in zip(piece, piece[1:], strict=False)}
    paired = {c for pair in pairs for c in pair}
    letters = {c for c in paired if re.match(r"[^\W_]", c)}
    other: set[str] = set()
    while ends := {a for a, b in pairs if a in letters and b not in letters and b != SPACE}:
        letters -= ends
        other |= ends
    alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in paired and not c.isalnum())
    odd = "_" + "".join(re.escape(c) for c in sorted(other))
    letter, rest = rf"[^\W{odd}]", rf"(?:(?![{SPACE}{alone}])[\W{odd}])"
    return re.compile(f"{SPACE}*(?:{rest}*{letter}+|{rest}+)|{SPACE}+" + (f"|[{alone}]" if alone else ""))


class MergeEncoder:
    """Encodes and decodes texts with the vocabulary of a SentencePiece model of merge type with byte fallback.

    The model must use identity normalisation with a leading space mark and keep all white space, as public 32k merge models do;
    another model is refused.
    """

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if not plain or kind.model_type != 2 or not kind.byte_fallback or kind.treat_whitespace_as_suffix:
            raise ValueError("only merge models with identity normalisation, a leading space and byte fallback")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("pieces that a user defined, or that are unused, are matched before merging: not supported")
        sp = SentencePieceProcessor(model_file=model_file)
        self.end_id = sp.eos_id()
        self.scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece goes on after a later space mark")
        if any(_BETWEEN in p for p in self.scores):
            raise ValueError("a piece holds the sign between chunks")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_ids = [byte_id[b] for b in range(256)]
        self.texts = [b""] * len(model.pieces)
        for piece, i in self.ids.items():
            self.texts[i] = piece.replace(SPACE, " ").encode()
        for b, i in byte_id.items():
            self.texts[i] = bytes([b])
        self.found, self.reach = ahocorasick.Automaton(), set()
        self.rank = {p: i for i, p in enumerate(sorted(self.scores, key=lambda p: -self.scores[p]))}  # in the order of merging
        self.made: dict[str, tuple[str, str]] = {}  # the two parts of each piece's last merge
        for piece in self.scores:
            if len(piece) > 1 and self.merged(piece) == [piece]:  # the others never come out of merging
                self.found.add_word(piece, len(piece))
                self.reach.add(piece)
                self.made[piece] = tuple(self.merged(piece, 2))
        self.found.make_automaton()
        # Merges can be played back where each piece has a score of its own and comes after its parts; the others (runs of spaces) and what
        # they are in or may come out of at a boundary are merged again from their characters.
        seen: dict[float, int] = {}
        for score in self.scores.values():
            seen[score] = seen.get(score, 0) + 1
        odd = [p for p, parts in self.made.items() if seen[self.scores[p]] > 1 or any(part in self.made and self.rank[part] > self.rank[p] for part in parts)]
        self.odd = {p for p in self.scores if any(o in p for o in odd)}
        self.odd_pairs = {(x, y) for o in odd for x, y in zip(o, o[1:], strict=False)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.cut = _cutter(self.scores)
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Plain merging of a short text, to `stop` parts at least: the neighbours with the best joined piece first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > _KNOWN_PAIRS:
                self.fits.clear()
            again = left in self.odd or right in self.odd or (left[-1], right[0]) in self.odd_pairs
            known = self.fits[left, right] = self.merged(left + right) == [left, right] if again else self.stay(left, right)
        return known

    def stay(self, left: str, right: str) -> bool:
        """Whether merging the joined text gives the two pieces: the same as merging it, played back from its last merge.

        Each turn undoes the later of the two pieces' last merges. A merge over the boundary must not have come before it; of
        equal ones the left comes first.
        """
        rank, made, before = self.rank, self.made, len(self.rank) + 1
        while True:
            if rank.get(left + right, before) < before:
                return False
            a, b = rank[left] if left in made else -1, rank[right] if right in made else -1
            if a > b:
                before, left = a, made[left][1]
            elif b >= 0:
                before, right = b + 1, made[right][0]
            else:
                return True

    def scan(self, text: str) -> list[int]:
        """Length of the longest piece from each place; the automaton's matches come by their ends, so later ones are longer."""
        longest = [1] * len(text)
        for end, length in self.found.iter(text):
            longest[end - length + 1] = length
        return longest

    def split(self, text: str, longest: list[int] | None = None) -> list[str]:
        """Pieces (or single unknown characters) of a text, by backtracking."""
        n = len(text)
        if n < 2:
            return list(text)
        fits, reach = self.fits.get, self.reach
        if longest is None:
            longest = self.scan(text)
        failed = None  # bitfield of positions from which there is no way on
        out: list[str] = []
        at, last = 0, ""
        length = longest[0]
        while at < n:
            while length:
                to = at + length
                piece = text[at:to]
                if (length == 1 or piece in reach) and (failed is None or not failed[to >> 3] >> (to & 7) & 1):
                    if not last:
                        break
                    fit = fits((last, piece))
                    if self.compatible(last, piece) if fit is None else fit:
                        break
                length -= 1
            if length:
                out.append(piece)
                last, at = piece, to
                if at < n:
                    length = longest[at]
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                length = len(out.pop())
                at -= length
                length -= 1
                last = out[-1] if out else ""
        return out

    def chunk_ids(self, chunk: str, longest: list[int]) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self.split(chunk, longest):
            known = self.ids.get(piece)
            if known is None:
                ids.extend([self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")])
            else:
                ids.append(known)
        return tuple(ids)

    def learned(self, chunks: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of chunks that aren't in the newer cache, kept there if they are short. Many chunks are scanned at once."""
        known = {c: self.older.get(c) for c in dict.fromkeys(chunks)}
        new = [c for c, ids in known.items() if ids is None]
        while new:
            size, n = 0, 0
            while n < len(new) and (not n or size + len(new[n]) < _SCANNED_CHARS):
                size, n = size + len(new[n]) + 1, n + 1
            longest, at = self.scan(_BETWEEN.join(new[:n])), 0
            for chunk in new[:n]:
                known[chunk] = self.chunk_ids(chunk, longest[at : at + len(chunk)])
                at += len(chunk) + 1
            new = new[n:]
        for chunk, ids in known.items():
            if len(chunk) <= _CACHED_CHARS:
                if len(self.chunks) >= _CACHED_CHUNKS:
                    self.chunks, self.older = {}, self.chunks
                self.chunks[chunk] = ids
        return known

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text with the end id last."""
        if not text:
            return [self.end_id]
        found = self.cut.findall(SPACE + text.replace(" ", SPACE))
        parts = list(map(self.chunks.get, found))
        missing = [i for i, part in enumerate(parts) if part is None]
        if missing:
            known = self.learned([found[i] for i in missing])
            for i in missing:
                parts[i] = known[found[i]]
        ids = list(chain.from_iterable(parts))
        ids.append(self.end_id)
        return ids

    def decoded(self, ids) -> bytes:
        """UTF-8 of what ids decode to, before anything is replaced."""
        return b"".join(map(self.texts.__getitem__, ids)).removeprefix(b" ")

    def decode(self, ids) -> str:
        """The text of ids: space marks to spaces, the leading one dropped, bytes joined, what is no UTF-8 replaced."""
        return self.decoded(ids).decode("utf-8", "replace")


def _encode_column(model_file: str):
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    kept: list[MergeEncoder] = []  # for a task; its caches go with it

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def encode(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(MergeEncoder(model_file))
        enc = kept[0]
        values, ends, decoded = array("i"), [0], []
        for t in texts:
            ids = enc.encode(t.as_py())
            values.extend(ids)
            ends.append(len(values))
            decoded.append(enc.decode(ids))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32)))
        decoded = pa.array(decoded, pa.string())
        return pa.StructArray.from_arrays([lists, decoded], fields=list(kind))

    return encode


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): ids end with the end id; decoded is what these ids decode to.

    A null or empty text gives the end id alone and an empty text. One row for each row of docs, repeated ids included; columns
    other than the two named are not read. No shuffle: each text is encoded where it is read.
    """
    coded = _encode_column(model_file)(F.col(text_col))
    return bounded_batches(docs).select(F.col(id_col), coded.alias("_c")).select(id_col, "_c.ids", "_c.decoded")


def decode_ids(df: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds out_col: the text that the ids decode to (null ids: null). Control ids give nothing; unknown ids are an error.

    A column of that name must not be there yet. Repeated rows are each decoded; an empty table gives an empty result.
    """
    if out_col in df.columns:
        raise ValueError(f"there is a column {out_col} already")
    kept: list[MergeEncoder] = []

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        if not kept:
            kept.append(MergeEncoder(model_file))
        return pa.array([None if x is None else kept[0].decode(x) for x in ids.to_pylist()], pa.string())

    return bounded_batches(df).withColumn(out_col, decode(F.col(ids_col)))


def token_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what encode_documents gives."""
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
