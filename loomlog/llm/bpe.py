"""BPE encoding as a streaming transducer, and decoding as an incremental state machine.

Encoding. A word arrives symbol by symbol. If merging a whole word gives tokens t1..tn, then merging
the symbols of t1..tk gives t1..tk: no merge crossed that border, so both sides went their own ways.
Every border of a later result lies within the longest token's length of the symbols read so far. So
the tokens that the merged prefixes ending in that window have in common are final: they are emitted,
and only the rest is kept. The window, the sufficient lookahead, is computed from the merge list. A
word's end settles all of it, so short words never wait.

Decoding. Ids go in, text comes out as soon as it is certain. With a byte-level decoder the bytes of
a character may be spread over ids, and the machine keeps at most three bytes. Without a decoder the
text is the tokens with one space between them, as the tokenizer's file says.

Nulls: a null text is the empty text (no ids); null ids and repeated rows are kept as they are. An empty
table gives no rows. A word of any length is worked through as it comes: what has settled is given out.
Columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loomlog.llm.common import pick, shipped_tokenizer, table, texts

#: Entries of a worker's memory of encoded words; it is emptied when full.
MEMORY = 300_000
#: A pair of ids, or a rank and an id, in one integer.
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
NONE = 1 << 62
#: Symbols a word may have before the transducer emits in between.
BUFFER = 128


def byte_symbols() -> dict[int, str]:
    """Printable stand-ins for bytes: visible Latin-1 characters stay, others go to 256 and up."""
    stays = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in stays]
    return {**{b: chr(b) for b in stays}, **{b: chr(256 + i) for i, b in enumerate(moved)}}


class Transducer:
    """Merges the symbols of one word; `ranks` maps a pair of ids to its rank and the merged id, both
    as one integer."""

    def __init__(self, ranks: dict[int, int], lengths: dict[int, int], buffer: int = BUFFER) -> None:
        self.ranks, self.lengths = ranks, lengths
        self.lookahead = max(lengths.values(), default=1)
        self.buffer = max(buffer, 2 * self.lookahead)

    def merged(self, ids: list[int]) -> list[int]:
        """All merges, lowest rank first and leftmost among equals."""
        get = self.ranks.get
        pairs = [get(a << ID_BITS | b, NONE) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            new, i = best & ID_MASK, pairs.index(best)
            while True:
                ids[i : i + 2] = [new]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = get(new << ID_BITS | ids[i + 1], NONE)
                if i:
                    pairs[i - 1] = get(ids[i - 1] << ID_BITS | new, NONE)
                if best not in pairs:
                    break
                i = pairs.index(best)
        return ids

    def settled(self, symbols: list[int]) -> list[int]:
        """Tokens at the front of `symbols` that no further symbol can change."""
        common = self.merged(symbols[: len(symbols) - self.lookahead + 1])
        for end in range(len(symbols) - self.lookahead + 2, len(symbols) + 1):
            other = self.merged(symbols[:end])
            n = 0
            for a, b in zip(common, other):
                if a != b:
                    break
                n += 1
            del common[n:]
        return common

    def word(self, symbols: Iterable[int]) -> Iterator[int]:
        """Ids of one word, whose last symbol ends it, given out as they settle."""
        kept: list[int] = []
        limit = self.buffer
        for symbol in symbols:
            kept.append(symbol)
            if len(kept) >= limit:
                done = self.settled(kept)
                yield from done
                del kept[: sum(self.lengths[t] for t in done)]
                limit = max(self.buffer, 2 * len(kept))
        yield from self.merged(kept)


class Decoder:
    """Ids to text, piece by piece; `finish` gives what is left."""

    def __init__(self, tokens: list[str], byte_level: bool, suffix: str = "") -> None:
        self.byte_level, self.first, self.tokens = byte_level, True, tokens
        if byte_level:
            back = {s: b for b, s in byte_symbols().items()}
            self.raw = [_raw(t, suffix, back) for t in tokens]
            self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if self.byte_level:
            return self.state.decode(b"".join(map(self.raw.__getitem__, ids)))
        text = " ".join(map(self.tokens.__getitem__, ids))
        if text and not self.first:
            text = " " + text
        self.first = self.first and not ids
        return text

    def finish(self) -> str:
        if self.byte_level:
            rest = self.state.decode(b"", final=True)
            self.state.reset()
            return rest
        self.first = True
        return ""


def _raw(token: str, suffix: str, back: dict[str, int]) -> bytes:
    end = bool(suffix) and token.endswith(suffix)
    body = token[: -len(suffix)] if end else token
    if not all(c in back for c in body):
        return token.encode()
    return bytes(back[c] for c in body) + (b" " if end else b"")


class WordTokenizer:
    """Encoder and decoder of a tokenizer file with NFC, one-space, lower-case normalising, a pattern
    whose matches are the words, byte symbols and an end-of-word suffix."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["use_regex"]:
            raise ValueError("another kind of tokenizer")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {}
        for token in spec["added_tokens"]:
            self.tokens[token["id"]], self.special[token["content"]] = token["content"], token["id"]
        symbols = byte_symbols()
        self.inner = [vocab[symbols[b]] for b in range(256)]
        self.last = [vocab[symbols[b] + suffix] for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {}
        for rank, (a, b) in enumerate(merges):
            ranks.setdefault(vocab[a] << ID_BITS | vocab[b], rank << ID_BITS | vocab[a + b])
        lengths = {i: len(t.removesuffix(suffix)) or 1 for t, i in vocab.items()}
        self.transducer = Transducer(ranks, lengths)
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.byte_level, self.suffix = spec["decoder"] is not None, suffix
        self._word: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def encode_word(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers."""
        ids = self._word.get(word)
        if ids is None:
            raw, machine = word.encode(), self.transducer
            symbols = [self.inner[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            ids = np.array(list(machine.word(symbols)), "<u4").tobytes()
            if len(word) < 64:
                if len(self._word) >= MEMORY:
                    self._word.clear()
                self._word[word] = ids
        return ids

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. White space parts words, and neither composing nor
        lower case moves anything across it, so pieces between white space are looked up."""
        # Lower case goes character by character: no final sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # split() takes these for white space, the pattern does not
            return b"".join(map(self.encode_word, self.words.findall(text)))
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; the strings of special tokens are those tokens."""
        if self.specials is None or not any(s in text for s in self.special):
            return np.frombuffer(self.encode_plain(text), "<u4")
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self.encode_plain(text[at:])]), "<u4")

    def decoder(self, byte_level: bool | None = None) -> Decoder:
        """State machine of the tokenizer's own decoder, or of bytes to text."""
        return Decoder(self.tokens, self.byte_level if byte_level is None else byte_level, self.suffix)


class _Chunks(dict):
    """Ids of text between white space."""

    def __init__(self, of: WordTokenizer) -> None:
        self.of = of

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(map(self.of.encode_word, self.of.words.findall(chunk)))
        if len(chunk) < 64:
            if len(self) >= MEMORY:
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def word_tokenizer(tokenizer_json: str) -> WordTokenizer:
    return WordTokenizer(tokenizer_json)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True, with_text: bool = False, piece: int = 4096) -> DataFrame:
    """Whole texts encoded, then decoded from the ids: (id, n_tokens, ids_sha256, decoded_sha256[,
    ids][, decoded]). Ids go through the decoder `piece` at a time."""
    shipped = shipped_tokenizer(docs.sparkSession, tokenizer_path)
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(shipped.value)
        machine = tokenizer.decoder()
        for batch in batches:
            counts, hashes, decoded, ids_out, texts_out = [], [], [], [], []
            for text in texts(batch, text_col):
                ids = tokenizer.encode(text)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(ids).hexdigest())
                digest, parts = hashlib.sha256(), []
                for at in range(0, len(ids), piece):
                    out = machine.feed(ids[at : at + piece].tolist())
                    digest.update(out.encode())
                    if with_text:
                        parts.append(out)
                out = machine.finish()
                digest.update(out.encode())
                decoded.append(digest.hexdigest())
                if with_ids:
                    ids_out.append(ids.astype(np.int32))
                if with_text:
                    texts_out.append("".join([*parts, out]))
            columns = [batch.column(id_col), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                columns.append(pa.array(texts_out, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pick(docs, id_col, text_col).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
