"""SentencePiece BPE encoding by backtracking, and decoding.

The pieces of a model file become a table of merges: each piece that byte-pair
encoding can produce is the merge of two smaller ones. A text is encoded
without replaying merges: an Aho-Corasick automaton gives the longest piece at
each place, a piece may follow another only if re-merging the two would leave
the border between them alone, and where no piece fits the search steps back,
with a bit for each place from which no encoding is left.

A model whose pieces never hold white space after other text cannot merge over
such a border, nor one that keeps Latin letters apart over the edge of a run of
them, so each word with its leading spaces is encoded on its own and
remembered. Pieces of equal score (runs of spaces) are merged leftmost first;
words that hold such a run take the plain merge loop.

Defined results: a null text is an empty one, which has only the begin and end
ids. Characters without a piece become byte pieces, or the unknown id where the
model has none. Texts of any length are encoded whole; the memory of words is
bounded and only saves time. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
from sentencepiece import SentencePieceProcessor

SPACE = "▁"
#: Latin letters; most models keep them apart from digits and marks.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"
#: Words that a Python worker remembers at most.
MEMORY = 800_000


class PieceTable:
    """What encoding and decoding need of a model file."""

    def __init__(self, model: bytes):
        source = SentencePieceProcessor(model_proto=model)
        count = source.vocab_size()
        names = [source.id_to_piece(i) for i in range(count)]
        self.bos, self.eos, self.unk = source.bos_id(), source.eos_id(), source.unk_id()
        plain = [
            i
            for i in range(count)
            if not (source.is_control(i) or source.is_byte(i) or source.is_unknown(i) or source.is_unused(i))
        ]
        self.byte_ids = {int(names[i][1:-1], 16): i for i in range(count) if source.is_byte(i)}
        self.piece_ids = {names[i]: i for i in plain}
        scores = {names[i]: source.get_score(i) for i in plain}
        self.scores = scores
        self._rank(scores)
        self.known = {t for t in self.text if len(t) == 1}
        self.rank_ids = [self._ids(t) for t in self.text]
        self._spans(scores)
        self.decoded: list[bytes] = [b""] * count
        for i in plain:
            self.decoded[i] = names[i].replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            self.decoded[i] = bytes([byte])
        self.decoded[self.unk] = " ⁇ ".encode()
        self.led = {i for i in plain if names[i].startswith(SPACE)}
        self.silent = {i for i in range(count) if source.is_control(i)}

    def _rank(self, scores: dict[str, float]) -> None:
        """Number the single characters, then the pieces that merging can produce, by falling score."""
        chars = sorted({c for name in scores for c in name})
        self.text: list[str] = list(chars)
        self.rank = {c: n for n, c in enumerate(chars)}
        self.parts: list[tuple[int, int] | None] = [None] * len(chars)
        self.merged: dict[tuple[int, int], int] = {}
        for name in sorted((n for n in scores if len(n) > 1), key=lambda n: (-scores[n], self.piece_ids[n])):
            for cut in range(1, len(name)):
                left, right = self.rank.get(name[:cut]), self.rank.get(name[cut:])
                if left is not None and right is not None and self.may_follow(left, right):
                    number = len(self.text)
                    self.text.append(name)
                    self.rank[name] = number
                    self.parts.append((left, right))
                    self.merged[left, right] = number
                    break
        self.shorter: list[int | None] = [
            next((r for end in range(len(t) - 1, 0, -1) if (r := self.rank.get(t[:end])) is not None), None)
            for t in self.text
        ]
        self.sizes = [len(t) for t in self.text]
        #: Answers of may_follow that are remembered, by left << 20 | right.
        self.agreed: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for name, number in self.rank.items():
            self.automaton.add_word(name, (number, len(name)))
        self.automaton.make_automaton()

    def _spans(self, scores: dict[str, float]) -> None:
        """How a text falls into words that no piece crosses, and which words need plain merging."""
        bare = [name.lstrip(SPACE) for name in scores]
        breaks = "" if any("\n" in name and len(name) > 1 for name in scores) else "\n"
        if any(SPACE in name for name in bare):
            self.words = re.compile(r"(?s).+")
        elif any(re.search(rf"[{LATIN}][^{LATIN}]|[^{LATIN}][{LATIN}]", name) for name in bare):
            self.words = re.compile(rf"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+|\n+")
        else:
            self.words = re.compile(rf"{SPACE}*(?:[{LATIN}]+|[^{LATIN}{SPACE}{breaks}]+)|{SPACE}+|\n+")
        counts: dict[float, int] = {}
        for name in scores:
            if len(name) > 1:
                counts[scores[name]] = counts.get(scores[name], 0) + 1
        equal = [re.escape(n) for n in scores if len(n) > 1 and counts[scores[n]] > 1]
        self.equal = re.compile("|".join(sorted(equal, key=len)) or r"(?!)")

    def may_follow(self, left: int, right: int) -> bool:
        """Whether re-merging two adjacent pieces would leave the border between them alone.

        The parts that touch the border are opened from the later merge down;
        any merge over the border that would have come before is a conflict.
        """
        bound = len(self.text)
        a: int | None = left
        b: int | None = right
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < bound:
                return False
            open_left = a > b
            whole = a if open_left else b
            pair = self.parts[whole]
            if pair is None:
                # A single character on this side: the other side may still open.
                other = b if open_left else a
                if self.parts[other] is None:
                    return True
                open_left, whole, pair = not open_left, other, self.parts[other]
            bound = whole if open_left else whole + 1
            if open_left:
                a = pair[1]
            else:
                b = pair[0]

    def known_run(self, text: str) -> list[int]:
        """Ranks that encode a text of known characters."""
        longest: dict[int, int] = {}
        for end, (number, size) in self.automaton.iter(text):
            longest[end - size + 1] = number  # a later end is a longer piece
        sizes, shorter, agreed, failed = self.sizes, self.shorter, self.agreed, 0
        out: list[int] = []
        at, piece, last, size = 0, longest[0], -1, len(text)
        while at < size:
            end = at + sizes[piece]
            fits = not failed >> end & 1
            if fits and last >= 0:
                fits = agreed.get(last << 20 | piece)
                if fits is None:
                    if len(agreed) > MEMORY:
                        agreed.clear()
                    fits = agreed[last << 20 | piece] = self.may_follow(last, piece)
            if fits:
                out.append(piece)
                at, last, piece = end, piece, longest.get(end)
                continue
            less = shorter[piece]
            if less is not None:
                piece = less
                continue
            failed |= 1 << at
            piece = out.pop()
            at -= sizes[piece]
            last = out[-1] if out else -1
        return out

    def plain_merge(self, text: str) -> list[str]:
        """The pieces of a text by the merge loop itself: best score first, then leftmost."""
        parts = list(text)
        left = list(range(-1, len(parts) - 1))
        right = [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (both := parts[i] + parts[j]) in self.scores:
                heapq.heappush(queue, (-self.scores[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def _ids(self, piece: str) -> bytes:
        number = self.piece_ids.get(piece)
        if number is not None:
            found = [number]
        elif self.byte_ids:
            found = [self.byte_ids[b] for b in piece.encode()]
        else:
            found = [self.unk]
        return np.array(found, "<u4").tobytes()

    def word_ids(self, word: str) -> bytes:
        """The ids of one word, as little-endian unsigned 32-bit integers."""
        if word in self.piece_ids and word in self.rank:
            return self._ids(word)
        if self.equal.search(word):
            return b"".join(map(self._ids, self.plain_merge(word)))
        if self.known.issuperset(word):
            return b"".join(map(self.rank_ids.__getitem__, self.known_run(word)))
        out, start = [], 0
        for at in [i for i, c in enumerate(word) if c not in self.known] + [len(word)]:
            if at > start:
                out += [self.rank_ids[r] for r in self.known_run(word[start:at])]
            if at < len(word):
                out.append(self._ids(word[at]))
            start = at + 1
        return b"".join(out)


class Codec(dict):
    """Encodes and decodes whole texts; as a dict it remembers words as little-endian 32-bit ids."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> bytes:
        found = self.table.word_ids(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a text with begin and end ids, as little-endian unsigned 32-bit integers."""
        ends = np.array([self.table.bos, self.table.eos], "<u4").tobytes()
        if not text:
            return ends
        words = self.table.words.findall(SPACE + text.replace(" ", SPACE))
        if len(self) > MEMORY:
            self.clear()
        return ends[:4] + b"".join(map(self.__getitem__, words)) + ends[4:]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        said = b"".join(map(self.table.decoded.__getitem__, numbers))
        first = next((n for n in numbers if n not in self.table.silent), None)
        if first in self.table.led:
            said = said[1:]
        try:
            return said.decode()
        except UnicodeDecodeError:
            return self._decode_broken(numbers, first)

    def _decode_broken(self, numbers: list[int], first: int | None) -> str:
        """Byte pieces that are no UTF-8: each byte that can't be read is one replacement sign."""
        of_byte = {i: b for b, i in self.table.byte_ids.items()}
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                    except UnicodeDecodeError:
                        continue
                    at += size
                    break
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for number in numbers:
            if number in of_byte:
                run.append(of_byte[number])
                continue
            flush()
            out.append(self.table.decoded[number].decode())
        flush()
        said = "".join(out)
        return said[1:] if first in self.table.led else said


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(PieceTable(model))


def encoded_texts(docs, model_file: str):
    """doc_id, ids (binary: little-endian unsigned 32-bit) and decoded text of each whole text."""
    return _mapped(docs, model_file, "doc_id long, ids binary, decoded string", lambda ids, said: (ids, said))


def encoded_digests(docs, model_file: str):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text."""
    from hashlib import sha256

    def digests(ids: bytes, said: str) -> tuple:
        return len(ids) // 4, sha256(ids).hexdigest(), sha256(said.encode()).hexdigest()

    return _mapped(docs, model_file, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs, model_file: str, schema: str, result):
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    from evalmill.llm.batches import bound_batches

    bound_batches(docs.sparkSession)
    with open(model_file, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    names = StructType.fromDDL(schema).names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = coder.encode(text.as_py())
                rows.append(result(ids, coder.decode(ids)))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [[]] * (len(names) - 1)
            yield pa.record_batch([batch.column("doc_id"), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, schema)
