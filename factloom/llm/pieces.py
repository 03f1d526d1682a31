"""SentencePiece encoding that keeps the source bytes of every piece, and decoding.

Normalisation follows the model's compiled character map: at each place the longest mapped prefix is replaced, any other character stays, and every
byte of the result remembers the source byte it came from. Blanks become U+2581 and, if the model says so, one stands in front. Segmentation of the
normalised text is left to the library; the byte lengths of its pieces then give each piece's span in the source.

Defined results: a null or empty text encodes to the end id alone and decodes to the empty text; pieces made of the added blank in front span no
source byte; the end id spans nothing at the end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.registry import query, table
from factloom.llm.shared import bounded_batches

MODEL = "piece_bpe_32k.model"
BLANK = "▁"


def public_model(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = blob[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(blob):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, blob[at:at + size]
        at += size


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes, and the zero-ended texts that replace them."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``data`` from ``at`` on, and what replaces it."""
        if not self.units:
            return None
        node, best = self._offset(self.units[0]), None
        for end in range(at, len(data)):
            node ^= data[end]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & ((1 << 31) | 255) != data[end]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & ((1 << 31) - 1)
                best = end + 1 - at, self.texts[start:self.texts.index(b"\0", start)]
        return best


class Encoder:
    """A loaded model; one for each task."""

    def __init__(self, path: str):
        import sentencepiece

        blob = open(path, "rb").read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        norm = next((dict(_fields(v)) for f, v in _fields(blob) if f == 3), {})
        self.map = CharacterMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        count = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(count)]
        self.lengths = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_control(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it stands for."""
        data = text.encode("utf-8", "surrogatepass")
        blank = BLANK.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            widths = np.where(raw == 32, len(blank), 1)
            source = np.repeat(np.arange(len(raw)), widths)
            out = data.replace(b" ", blank)
        else:
            parts, origin, at = [], [], 0
            while at < len(data):
                found = self.map.longest(data, at)
                if found:
                    width, new = found
                else:
                    lead = data[at]
                    width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                    new = data[at:at + width]
                parts += [new[k:k + 1] for k in range(len(new))]
                origin += [at] * len(new)
                at += width
            if self.squeeze:
                keep = [k for k, p in enumerate(parts) if p != b" " or (k and parts[k - 1] != b" ")]
                while keep and parts[keep[-1]] == b" ":
                    keep.pop()
                parts, origin = [parts[k] for k in keep], [origin[k] for k in keep]
            source = np.repeat(np.array(origin, np.int64), [len(blank) if p == b" " else 1 for p in parts]) if parts else np.zeros(0, np.int64)
            out = b"".join(blank if p == b" " else p for p in parts)
        if out and self.prefix:
            out = blank + out
            source = np.concatenate((np.zeros(len(blank), np.int64), source))
        return out, np.concatenate((source, [len(data)])).astype(np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of each text, with the end id."""
        return self.library.encode(texts, add_eos=True, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Source byte span of each piece: begins and ends."""
        norm, source = self.normalised(text)
        ends = np.cumsum(self.lengths[np.array(ids, np.int64)])
        if ends[-1] != len(norm):
            raise ValueError("pieces do not cover the normalised text")
        begins = np.concatenate(([0], ends[:-1]))
        return source[begins], source[ends]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encoded(df: DataFrame, path: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """All rows and columns, and ``out``: a struct of ``ids``, the source byte spans ``begins`` and ``ends``, and the ``decoded`` text."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("ids array<int>, begins array<int>, ends array<int>, decoded string")
    def run(texts: pd.Series) -> pd.DataFrame:
        model = encoder(path)
        plain = [t or "" for t in texts]
        ids = model.ids(plain)
        spans = [model.spans(t, i) for t, i in zip(plain, ids, strict=True)]
        return pd.DataFrame({"ids": ids, "begins": [b.astype(np.int32) for b, _ in spans], "ends": [e.astype(np.int32) for _, e in spans],
                             "decoded": model.library.decode(ids, num_threads=1) if ids else []})

    return df.withColumn(out, run(F.col(text)))


def encoding_digests(df: DataFrame, path: str, text: str = "text", out: str = "digests") -> DataFrame:
    """As ``encoded``, but only digests leave the task: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``spans_crc32`` (of begins and ends)."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint")
    def run(texts: pd.Series) -> pd.DataFrame:
        model = encoder(path)
        plain = [t or "" for t in texts]
        rows = []
        all_ids = model.ids(plain)
        for t, ids, back in zip(plain, all_ids, model.library.decode(all_ids, num_threads=1) if all_ids else [], strict=True):
            begins, ends = model.spans(t, ids)
            rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(),
                         zlib.crc32(ends.astype("<i4").tobytes(), zlib.crc32(begins.astype("<i4").tobytes()))))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return df.withColumn(out, run(F.col(text)))


@query("op7_sentencepiece")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """All whole documents, encoded and decoded."""
    return encoding_digests(table(spark, folder, "documents").select("doc_id", "text"), public_model()).select("doc_id", "digests.*")
