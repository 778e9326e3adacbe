"""Token ids as directly addressable codes.

A segment's ids are ranked by frequency and each rank is cut into chunks, low bits first. Level l
holds the l-th chunk of every id that has one, a bitmap tells which ids go on to the next level, and
a directory of ones before each block of the bitmap leads to the chunk's place there. Any token is
read with one chunk and one rank per level; nothing else is decoded. Segments are rows of an
uncompressed Parquet table in ascending doc_id order, each with a self-contained image.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, new_path, rows, texts

MAGIC, BLOCK = b"DAC1", 512
#: Tokens of a segment, and distinct words whose ids a worker remembers.
SEGMENT, WORDS = 1 << 20, 350_000


def _widths(hist: list[int]) -> list[int]:
    """Chunk widths of least size; hist[b]: ids whose rank has b bits."""
    top = max(b for b, n in enumerate(hist) if n) or 1
    left = [sum(hist[b + 1 :]) for b in range(top + 1)]
    left[0] = sum(hist)
    best: dict[int, tuple[int, list[int]]] = {top: (0, [])}
    for at in range(top - 1, -1, -1):
        best[at] = min(((left[at] * (w + (at + w < top)) + best[at + w][0], [w, *best[at + w][1]]) for w in range(1, top - at + 1)), key=lambda x: x[0])
    return best[0][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def _unpack(data, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits @ (1 << np.arange(width, dtype=np.uint32)).astype(np.uint32)


def encode(ids: np.ndarray) -> bytes:
    """The image of one segment."""
    ids = ids.astype(np.uint32)
    if len(ids) and ids.max() < 1 << 20:  # a vocabulary: count by id
        counts = np.bincount(ids)
        values = np.flatnonzero(counts).astype(np.uint32)
        counts = counts[values]
        place = np.zeros(int(ids.max()) + 1, dtype=np.uint32)
        place[values] = np.arange(len(values), dtype=np.uint32)
        place = place[ids]
    else:
        values, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(values), dtype=np.uint32)
    rank[order] = np.arange(len(values), dtype=np.uint32)
    codes = rank[place]
    length = np.ceil(np.log2(np.arange(len(values)) + 1.0)).astype(np.uint8)  # bits of each rank
    bits = length[codes]
    widths = _widths(np.bincount(bits, minlength=2).tolist()) if len(codes) else []
    out = [MAGIC, struct.pack("<III", len(codes), len(values), len(widths)), bytes(widths), values[order].astype("<u4").tobytes()]
    done = 0
    for k, w in enumerate(widths):
        chunk, done = _pack(codes & np.uint32((1 << w) - 1), w), done + w
        parts = [chunk]
        if k + 1 < len(widths):
            more = bits > done
            ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32)
            parts += [np.packbits(more, bitorder="little").tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()]
            codes, bits = (codes >> np.uint32(w))[more], bits[more]
        out += [struct.pack(f"<I{len(parts)}I", len(parts), *map(len, parts)), *parts]
    return b"".join(out)


class Segment:
    """Reads an image; ``s[i]`` touches only the chunks of token i, ``s.decode()`` gives all ids."""

    def __init__(self, image: bytes):
        view = memoryview(image)
        assert view[:4] == MAGIC, "not a segment image"
        self.n, n_values, n_levels = struct.unpack_from("<III", view, 4)
        self.widths = list(view[16 : 16 + n_levels])
        at = 16 + n_levels
        self.values = np.frombuffer(view, dtype="<u4", count=n_values, offset=at)
        at += 4 * n_values
        self.levels = []
        for _ in self.widths:
            (count,) = struct.unpack_from("<I", view, at)
            sizes = struct.unpack_from(f"<{count}I", view, at + 4)
            at += 4 + 4 * count
            parts = []
            for size in sizes:
                parts.append(view[at : at + size])
                at += size
            self.levels.append(parts)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = shift = 0
        for w, (chunk, *rest) in zip(self.widths, self.levels):
            first, last = i * w // 8, (i * w + w - 1) // 8 + 1
            code |= ((int.from_bytes(chunk[first:last], "little") >> (i * w % 8)) & ((1 << w) - 1)) << shift
            shift += w
            if not rest or not rest[0][i // 8] >> (i % 8) & 1:
                break
            block = i // BLOCK
            before = int.from_bytes(rest[0][block * BLOCK // 8 : i // 8], "little").bit_count() + (rest[0][i // 8] & ((1 << (i % 8)) - 1)).bit_count()
            i = struct.unpack_from("<I", rest[1], 4 * block)[0] + before
        return int(self.values[code])

    def decode(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, dtype=np.uint32)
        codes, alive, shift = np.zeros(self.n, dtype=np.uint32), np.arange(self.n), 0
        for w, (chunk, *rest) in zip(self.widths, self.levels):
            codes[alive] |= _unpack(chunk, len(alive), w) << np.uint32(shift)
            shift += w
            if rest:
                alive = alive[np.unpackbits(np.frombuffer(rest[0], dtype=np.uint8), count=len(alive), bitorder="little").astype(bool)]
        return self.values[codes]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Memo(dict):
    """Remembers at least WORDS and at most twice as many words; those in use outlive the rest."""

    def __init__(self):
        self.old: dict = {}

    def __missing__(self, word):
        self[word] = value = self.old[word]
        return value

    def room(self):
        if len(self) > WORDS:
            self.old = dict(self)
            self.clear()


class _Pieces(_Memo):
    """Ids, as bytes, of the pieces words are cut into; one that is new goes to ``model``."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.marks = model.tokenize, _byte_marks()

    def __missing__(self, p):
        value = self.old.get(p)
        if value is None:
            marked = p if p.isascii() else "".join(map(self.marks.__getitem__, p.encode()))
            ids = [t.id for t in self.tokenize(marked)]
            value = struct.pack(f"<{len(ids)}I", *ids)
        self[p] = value
        return value


#: Words of printable ASCII and single Latin letters, on which normalising is lower-casing alone.
_SIMPLE = re.compile("[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
_LETTERS = "a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F"


def _byte_marks() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    out, more = [], 256
    for b in range(256):
        plain = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD
        out.append(chr(b) if plain else chr(more))
        more += not plain
    return out


class _Words:
    """Ids, as bytes, of words between ASCII white space; exact where the tokenizer drops white space.

    Where the tokenizer lower-cases and its byte-level BPE takes letter runs, digits and runs of signs
    each for itself, simple words are cut into these here and each distinct piece goes to the
    library's BPE model once; all other words go through the library's whole encoding.
    """

    def __init__(self, path: str):
        self.tok, self.known = _tokenizer(path), _Memo()
        self.pieces = _Pieces(self.tok.model)
        d = json.loads(self.tok.to_str())
        steps = [x.get("type") for x in (d.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex", "") for x in (d.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.simple = steps == ["NFC", "Replace", "Lowercase"] and len(split) == 2 and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in split[0] and d["model"]["type"] == "BPE"
        endings = split[0].split("|[")[0] if self.simple else ""
        self.cut = re.compile(f"{endings}|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+").findall

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))

    def learn(self, texts: list[list[bytes]]) -> None:
        """The words of these texts that are new; those that are not simple as one text, cut again where each word begins."""
        self.known.room(), self.pieces.room()
        known, piece, cut, whole = self.known, self.pieces.__getitem__, self.cut, _SIMPLE.fullmatch
        rest = []
        for w in set().union(*texts).difference(known).difference(known.old):
            s = w.decode()
            if self.simple and whole(s) and "<|" not in s:
                known[w] = b"".join(map(piece, cut(s.lower())))
            else:
                rest.append((w, s))
        for at in range(0, len(rest), 2000):
            part = rest[at : at + 2000]
            e = self.tok.encode(" ".join(s for _, s in part), add_special_tokens=False)
            first = np.cumsum([0, *(len(s) + 1 for _, s in part)])
            starts = np.array([x for x, _ in e.offsets], dtype=np.int64)
            cuts = np.searchsorted(starts, first).tolist()
            raw = np.array(e.ids, dtype="<u4").tobytes()
            known.update((w, raw[4 * a : 4 * b]) for (w, _), a, b in zip(part, cuts, cuts[1:]))


SEGMENTS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_sizes", pa.binary()), ("image", pa.binary())])


def _tokenised(batches, path, bounds, end_id, by_word):
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    words = held(("words", path), lambda: _Words(path))
    cuts, end = np.array(bounds, dtype=np.int64), np.array([end_id], dtype="<u4").tobytes()
    for ids, text in rows(batches):
        if by_word:
            split = [t.split() for t in text]
            words.learn(split)
            found = [words.ids(t) + end for t in split]
        else:
            found = [np.array(e.ids, dtype="<u4").tobytes() + end for e in words.tok.encode_batch([t.decode() for t in text], add_special_tokens=False)]
        part = np.searchsorted(cuts, np.array([-(1 << 63) if i is None else i for i in ids], dtype=np.int64), side="left")
        small = [np.frombuffer(f, dtype="<u4") for f in found]
        wide = [bool(len(s) and s.max() > 65535) for s in small]
        packed = [squeeze.compress(bytes([w]) + s.astype("<u4" if w else "<u2").tobytes()) for s, w in zip(small, wide)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["part", "doc_id", "ids"])


def _segments(batches):
    import zstandard

    plain = zstandard.ZstdDecompressor()
    ids, docs, sizes, total, start, seq, part = [], [], [], 0, 0, 0, 0

    def flush():
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
        return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "part_start": start, "n_tokens": total, "doc_ids": b"".join(docs), "doc_sizes": np.array(sizes, dtype="<u8").tobytes(), "image": encode(flat)}], schema=SEGMENTS)

    for batch in batches:
        for p, d, z in zip(*(c.to_pylist() for c in batch.columns)):
            raw = plain.decompress(z)
            one = np.frombuffer(raw, dtype="<u4" if raw[0] else "<u2", offset=1)
            part = p
            ids.append(one), docs.append(struct.pack("<?q", d is None, d or 0)), sizes.append(len(one))
            total += len(one)
            if total >= SEGMENT:
                yield flush()
                start, seq = start + total, seq + 1
                ids, docs, sizes, total = [], [], [], 0
    if sizes:
        yield flush()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, parts: int | None = None, by_word: bool = False) -> str:
    """Encode every whole text, append ``end_id``, and write segments to ``path`` in ascending doc_id order.

    ``parts`` ranges of doc_id (default: the shuffle partitions) are cut at quantiles of the ids of all
    rows. by_word: encode each word between ASCII white space once and reuse it, for tokenizers that
    drop white space; False hands the library whole texts. Null text is empty and yields the end id
    alone; rows with null doc_id come first; repeated rows are all written; other columns are left out.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = texts(docs)
    cuts = base.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    bounds = sorted(set(cuts or []))
    coded = base.mapInArrow(lambda it: _tokenised(it, tokenizer, bounds, end_id, by_word), "part int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id")
    schema = "part int, seq int, part_start long, n_tokens long, doc_ids binary, doc_sizes binary, image binary"
    dealt.mapInArrow(_segments, schema).write.option("compression", "none").parquet(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a token file; start counts the ids of all documents before it."""
    return _read(spark, path, "doc_id long, start long, ids array<int>", _lists)


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; the ids are little-endian unsigned 32-bit for the crc."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", _crcs)


def _read(spark, path, schema, what):
    table = spark.read.parquet(path)
    sums = table.groupBy("part").agg(F.sum("n_tokens")).collect()  # one row for each range
    base, total = {}, 0
    for part, n in sorted(map(tuple, sums)):
        base[part], total = total, total + n
    return table.mapInArrow(lambda it: _open(it, base, what), schema)


def _open(batches, base, what):
    for batch in batches:
        for row in batch.to_pylist():
            ids = Segment(row["image"]).decode()
            sizes = np.frombuffer(row["doc_sizes"], dtype="<u8").astype(np.int64)
            ends = np.cumsum(sizes)
            docs = [None if null else d for null, d in struct.iter_unpack("<?q", row["doc_ids"])]
            yield what(docs, base[row["part"]] + row["part_start"] + ends - sizes, ids, ends - sizes, ends)


def _lists(docs, start, ids, a, b):
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start, pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(a, b[-1:]), pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "start", "ids"])


def _crcs(docs, start, ids, a, b):
    raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start, pa.int64()), pa.array(b - a, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def tokens_at(spark, path: str, positions: list[int]) -> DataFrame:
    """(position, token) of the given places among all ids of a token file, each place once.

    Only segments that hold one are opened, and of these only the chunks of the token asked for: the
    rank directories lead from level to level and nothing is decoded. A place outside is an IndexError.
    """
    table = spark.read.parquet(path)
    sizes = sorted(map(tuple, table.groupBy("part").agg(F.sum("n_tokens")).collect()))  # one row for each range
    ends = np.cumsum([n for _, n in sizes], dtype=np.int64)
    asked = sorted(set(positions))
    if asked and not (len(ends) and 0 <= asked[0] and asked[-1] < ends[-1]):
        raise IndexError("a position outside the file")
    which = np.searchsorted(ends, np.array(asked, dtype=np.int64), side="right").tolist()
    wanted = [(sizes[k][0], int(i - ends[k] + sizes[k][1]), i) for i, k in zip(asked, which)]
    places = spark.createDataFrame(wanted, "at_part int, place long, position long")
    here = (F.col("part") == F.col("at_part")) & (F.col("place") >= F.col("part_start")) & (F.col("place") < F.col("part_start") + F.col("n_tokens"))
    found = table.where(F.col("part").isin([p for p, _, _ in wanted])).join(F.broadcast(places), here)
    return found.select("position", (F.col("place") - F.col("part_start")).alias("i"), "image").mapInArrow(_picked, "position long, token long")


def _picked(batches):
    for batch in batches:
        tokens = [Segment(image)[i] for i, image in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64())], names=["position", "token"])


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1, by_word: bool = False) -> DataFrame:
    path = write_tokens(docs, new_path(docs.sparkSession, "tokens"), tokenizer, end_id, by_word=by_word)
    return read_digests(docs.sparkSession, path)
