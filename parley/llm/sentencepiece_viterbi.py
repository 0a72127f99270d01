"""SentencePiece ids by streaming Viterbi over a model file, and decoding.

The lattice has a boundary after every character and an edge for every piece. Each boundary keeps one back pointer:

* unigram model: to the edge with the best sum of scores;
* merge (BPE) model: to the only edge whose piece stands behind the last piece of the shorter text without the merge
  rule wanting to join across their border. Every prefix of a text has exactly one such last piece, so the path is the
  one that merging by rank gives.

Only the boundaries within the longest piece can still be reached, so ids are committed as soon as the back pointers
of that window meet in one boundary, and everything before it is let go.

Cases: null counts as empty; an empty text has no ids. A character without a piece becomes its UTF-8 bytes if the model
has byte pieces, else the unknown id. Texts of any length run in the memory of one window, as long as paths meet.
Repeated rows get equal results. Other columns are not read.
"""

import array
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE_PARTS = 500_000
CACHED_LENGTH = 48
# Characters of the texts whose new words are walked together.
GROUP = 1_000_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces and rules of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.prefix, self.squeeze, self.escape = UNIGRAM, True, True, True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("models with a table of character rules are not supported")
                self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE) or any(t == USER for _, _, t in self.pieces):
            raise ValueError("only unigram and merge models without user pieces are supported")
        self.id = {p: k for k, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in self.pieces if t == NORMAL}
        self.byte = {int(p[3:-1], 16): k for k, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next(k for k, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        self.longest = max(map(len, self.id), default=1)
        # Where no piece has a space behind another character, words can be taken one by one.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        # Two neighbours that no piece holds: every path has a boundary between them.
        self.inside = {a + b for p in self.id for a, b in zip(p, p[1:])}
        self.worst = min(self.score.values(), default=0.0) - 10
        lengths: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 2:
                lengths.setdefault(p[-3:], {2, 1} if p[-2:] in self.id else {1}).add(len(p))
        self.ends = {pair: tuple(sorted(own, reverse=True)) for pair, own in lengths.items()}
        self.spelled = [self._bytes(p, t) for p, _, t in self.pieces]
        self.unit = [struct.pack("=I", k) for k in range(len(self.pieces))]
        # Pairs of piece ids, the left one times the number of pieces plus the right one; -1 for none on the left.
        self.joint: dict[int, bool] = {}

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        """What an id stands for in a decoded text."""
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        return {NORMAL: piece.replace(SPACE, " "), UNKNOWN: " ⁇ "}.get(kind, "").encode()

    def normal(self, text: str) -> str:
        """Text as the lattice sees it."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def apart(self, left: str, right: str) -> bool:
        """Whether merging the best pair over and over ends in these two pieces; it must never join across their border."""
        parts, get, none = list(left + right), self.score.get, -float("inf")
        rank = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        border = len(left) - 1
        while rank:
            best = max(rank)
            if best == none:
                break
            at = rank.index(best)
            if at == border:
                return False
            if at < border:
                border -= 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del rank[at]
            if at:
                rank[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(rank):
                rank[at] = get(parts[at] + parts[at + 1], none)
        return parts == ([left, right] if left else [right])

    def stands(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces stay apart, and each stays whole, under the merge rule; -1: none on the left."""
        if len(self.joint) > CACHE_PARTS:
            self.joint.clear()
        known = self.apart(self.pieces[left][0] if left >= 0 else "", self.pieces[right][0])
        self.joint[left * len(self.pieces) + right] = known
        return known


def _spell(model: Model, piece: str) -> list[int]:
    """Ids of a piece, or of a character without one."""
    own = model.id.get(piece)
    if own is not None:
        return [own]
    return [model.byte[b] for b in piece.encode("utf-8", "surrogatepass")] if model.byte else [model.unknown]


# Per boundary: boundary before, its piece, and the id of the piece (merge model; -1 for none) or the total score.
Back = dict[int, tuple[int, str, float]]


def _merge_edges(model: Model, text: str, low: int, high: int, back: Back) -> None:
    """Back pointers of the boundaries behind low up to high: the longest piece that stands behind its predecessor."""
    known, joint, stands, n = model.id, model.joint, model.stands, len(model.pieces)
    ends, few = model.ends, (2, 1)
    for end in range(low + 1, high + 1):
        # Lengths of the pieces that end in the same three characters, longest first.
        for size in ends.get(text[end - 3 : end], few) if end > 2 else few:
            start = end - size
            before = back.get(start)
            if before is None:
                continue
            piece = text[start:end]
            own = known.get(piece)
            if own is None:
                # A character without a piece never merges.
                if size == 1:
                    back[end] = (start, piece, -1)
                    break
                continue
            last = before[2]
            if last < 0 and size == 1:
                fits = True
            else:
                fits = joint.get(last * n + own)
                if fits is None:
                    fits = stands(last, own)
            if fits:
                back[end] = (start, piece, own)
                break


def _score_edges(model: Model, text: str, low: int, high: int, back: Back) -> None:
    """Back pointers of the boundaries behind low up to high: the best sum of scores."""
    ends, few = model.ends, (2, 1)
    for end in range(low + 1, high + 1):
        best = None
        for size in ends.get(text[end - 3 : end], few) if end > 2 else few:
            start = end - size
            before = back.get(start)
            if before is None:
                continue
            piece = text[start:end]
            if size > 1 and piece not in model.id:
                continue
            total = before[2] + model.score.get(piece, model.worst)
            if best is None or total > best[2]:
                best = (start, piece, total)
        if best is not None:
            back[end] = best


def viterbi(model: Model, text: str, commit: Callable[[str], None]) -> int:
    """Send the pieces of a normalised text to `commit` in order; returns the largest number of boundaries held."""
    longest, size = model.longest, len(text)
    edges, first = (_merge_edges, -1) if model.kind == BPE else (_score_edges, 0.0)
    # The committed boundary is the only one without a piece.
    back: Back = {0: (-1, "", first)}
    done = held = end = 0

    def path(to: int) -> list[str]:
        out = []
        while to != done:
            to, piece, _ = back[to]
            out.append(piece)
        return out[::-1]

    while end < size:
        low, end = end, min(end + longest, size)
        edges(model, text, low, end, back)
        held = max(held, len(back))
        if end == size:
            for piece in path(end):
                commit(piece)
            break
        live = {b for b in range(max(done, end - longest + 1), end + 1) if b in back}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(back[top][0])
        (meet,) = live
        if meet > done:
            for piece in path(meet):
                commit(piece)
            keep = {b: v for b, v in back.items() if b > meet}
            # What is known of the last piece stays, because the next one must stand behind it.
            back = {meet: (-1, *back[meet][1:]), **keep}
            done = meet
    return held


def walk_sorted(model: Model, texts: list[str], found: dict[str, bytes]) -> int:
    """Add the ids of short texts under a merge model to `found`; returns the characters walked.

    What stands before a boundary decides its last piece, so in sorted order each text goes on where it leaves the last.
    """
    known, joint, stands, n, unit = model.id, model.joint, model.stands, len(model.pieces), model.unit
    ends, few = model.ends, (2, 1)
    # Per boundary: id of its last piece (-1: a character without one, or the start; None: no path) and all ids up to it.
    room = max(map(len, texts), default=0) + 1
    lasts: list[int | None] = [-1] * room
    ids = [b""] * room
    before, walked = "", 0
    for text in sorted(texts):
        same = 0
        for a, b in zip(text, before):
            if a != b:
                break
            same += 1
        before, walked = text, walked + len(text) - same
        for end in range(same + 1, len(text) + 1):
            lasts[end] = None
            for size in ends.get(text[end - 3 : end], few) if end > 2 else few:
                start = end - size
                if start < 0:
                    continue
                last = lasts[start]
                if last is None:
                    continue
                own = known.get(text[start:end])
                if own is None:
                    # A character without a piece never merges.
                    if size == 1:
                        lasts[end], ids[end] = -1, ids[start] + array.array("I", _spell(model, text[start:end])).tobytes()
                        break
                    continue
                if last >= 0 or size > 1:
                    fits = joint.get(last * n + own)
                    if fits is None:
                        fits = stands(last, own)
                    if not fits:
                        continue
                lasts[end], ids[end] = own, ids[start] + unit[own]
                break
        found[text] = ids[len(text)]
    return walked


class Encoder:
    """Ids of whole texts, with the ids of the parts of recent words kept."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = Model(f.read())
        # Two generations of parts: when the young one is full, it becomes the old one.
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        out = array.array("I")
        viterbi(self.model, text, lambda piece: out.extend(_spell(self.model, piece)))
        return out.tobytes()

    def _words(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words; parts not seen before are walked together."""
        inside, parts, old = self.model.inside, self.parts, self.old
        get = parts.get
        done: dict[str, bytes] = {}
        left: list[tuple[str, str, str]] = []
        fresh: set[str] = set()
        for word in new:
            # A last character behind a forced boundary, such as a mark, is looked up on its own.
            part, mark = (word, "") if len(word) == 1 or word[-2:] in inside else (word[:-1], word[-1])
            ids, end = get(part), get(mark) if mark else b""
            if ids is None or end is None:
                for p in (part, mark):
                    if p and p not in parts:
                        if p in old:
                            parts[p] = old.pop(p)
                        else:
                            fresh.add(p)
                left.append((word, part, mark))
            else:
                done[word] = ids + end
        short = [p for p in fresh if len(p) <= CACHED_LENGTH]
        found = {p: self._ids(p) for p in fresh if len(p) > CACHED_LENGTH or self.model.kind != BPE}
        if self.model.kind == BPE:
            walk_sorted(self.model, short, found)
        for word, part, mark in left:
            ids = found.get(part)
            end = found.get(mark) if mark else b""
            done[word] = (parts[part] if ids is None else ids) + (parts[mark] if end is None else end)
        if len(parts) + len(short) > CACHE_PARTS // 2:
            self.old, self.parts = parts, {}
        self.parts.update((p, found[p]) for p in short)
        return done

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of whole texts, taken in groups of bounded size."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(self.model.normal(text or ""))
            size += len(group[-1])
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if not self.model.by_word:
            yield from map(self._ids, texts)
            return
        words = [_CHUNK.findall(t) for t in texts]
        ids = self._words(set().union(*words))
        for own in words:
            yield b"".join(map(ids.__getitem__, own))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """Text of ids: pieces and byte pieces one after another, without the space that stands for the start."""
        spelled = self.model.spelled
        text = b"".join(map(spelled.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text[:1] == " " else text


_READY: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """Encoder of this worker process."""
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian 32-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = list(own.encode_all(t.as_py() for t in batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text, and number and checksum of the ids it came from."""
    schema = "doc_id long, text string, n_ids long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = batch["ids"].to_pylist()
            columns = [
                batch["doc_id"],
                pa.array([own.decode(i or b"") for i in ids], pa.string()),
                pa.array([len(i or b"") // 4 for i in ids], pa.int64()),
                pa.array([zlib.crc32(i or b"") for i in ids], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_ids", "ids_crc32"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
