"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

The text is normalised by the tokenizer's own normaliser and cut into pre-tokens. A pre-token is encoded
in linear time: the automaton gives, for each position, the longest token that starts there; the encoder
takes it if its end is not known to be a dead end and if the pair with the token before it is one that
merging would leave as it is, else it tries the longest shorter prefix that is a token, else it goes back by
one token. Whether a pair can stand side by side is worked out from the merges and kept in a table.

Defined results: a null text is encoded as the empty text (no ids, empty decoded text). Special tokens that
stand in a text become their ids, as the library does by default. A text of any length is encoded whole, in
time that grows with its length. Repeated rows give repeated rows; ids may be null, repeat or be of any type and
are passed on as they are. An empty table gives an empty result. Other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, turn

#: Distinct pre-tokens, and pairs, that a worker keeps; a table is emptied when it's full.
CACHE_ENTRIES = 600_000
#: The pre-token pattern of the tokenizer file, on text whose only white space is the space.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+"
#: Texts of these characters only have one lower-case character for each and stay as they are under NFC, so
#: str.lower() and a pattern of plain ranges do what the normaliser and the pattern above do, and faster.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-\u012f\u0131-\u017f"
PLAIN = re.compile("[\\t-\\r -~\x85\xa0¡-\u012f\u0131-\u017f]*")
PLAIN_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0{LETTERS}0-9²³¹¼½¾]+")

#: Characters of which all Unicode versions in use agree whether they are letters or numbers. Elsewhere a newer version
#: knows more letters than the tokenizer's own pattern engine, so texts with others are cut by that engine.
AGREED = re.compile("[\\0-\u052f\u2010-\u205e\u3000-\u30ff\u4e00-\u9fa5]*")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BacktrackingBPE:
    """Encoder and decoder of one vocabulary with merges and a word-end suffix.

    A word's last character with the suffix is a symbol of its own, so a token is a string over at most 512
    symbols, and a word end needs no special case.
    """

    END = 0x2000  # added to the code of a word's last character

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pretoken = regex.compile(PRETOKEN)
        self.splitter = Split(Regex(PRETOKEN), "removed", invert=True)
        self.alphabet = byte_alphabet()
        suffix = model["end_of_word_suffix"] or ""
        text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.size = max(text_of) + 1
        # The offset table: token i is blob[offset[i]:offset[i + 1]].
        parts = [text_of.get(i, "").encode() for i in range(self.size)]
        self.blob, self.offset = b"".join(parts), [0]
        for p in parts:
            self.offset.append(self.offset[-1] + len(p))

        def symbols(token: str) -> str:
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                body = token[: -len(suffix)]
                return body[:-1] + chr(ord(body[-1]) + self.END)
            return token

        vocab = {symbols(t): i for t, i in model["vocab"].items()}
        self.length = {i: len(s) for s, i in vocab.items()}
        self.rank, self.merged, self.split = {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            new = model["vocab"][a + b]
            self.merged[vocab[symbols(a)], vocab[symbols(b)]] = new
            self.split[new] = (vocab[symbols(a)], vocab[symbols(b)])
            self.rank[new] = r
        # A token that its own merges don't give back never appears in a result: it stays out of the automaton.
        known = {s: i for s, i in vocab.items() if i in self.split or len(s) == 1}
        self.shorter = {}
        for s, i in known.items():
            k = len(s) - 1
            while k and s[:k] not in known:
                k -= 1
            self.shorter[i] = known[s[:k]] if k else None
        self.automaton = ahocorasick.Automaton()
        for s, i in known.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}  # the pair-compatibility table, filled as pairs turn up
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """True if merging, run on the two tokens' symbols, stops at exactly these two tokens."""
        if len(self.fits) >= CACHE_ENTRIES:
            self.fits.clear()
        known = self.fits[left << 20 | right] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undoes merges from the latest on. If at some moment the two parts that meet at the border have a
        merge that comes before the next one that would hide it, merging would have crossed the border."""
        rank, split, never = self.rank, self.split, len(self.rank)
        limit, strict = never, True  # a crossing merge wins if its rank is under limit, or equal to it if not strict
        while True:
            new = self.merged.get((a, b))
            if new is not None and (rank[new] < limit or (not strict and rank[new] == limit)):
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # of equal merges the left one is made first, so the right token's is undone first on a tie
                limit, strict = ra, True
                a = split[a][1]
            else:
                limit, strict = rb, False
                b = split[b][0]

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of one pre-token that is given as symbols."""
        n = len(word)
        longest, size = [None] * (n + 1), [0] * n
        for end, (k, i) in self.automaton.iter(word):
            at = end - k + 1
            if k > size[at]:
                size[at], longest[at] = k, i
        token = longest[0]
        if size[0] == n:  # the word is a token, and every token in the automaton is what its own merges give
            return [token]
        out: list[int] = []
        dead: set[int] = set()  # positions from which the rest can't be encoded after any prefix that got there
        at, last = 0, -1
        length, shorter, fits = self.length, self.shorter, self.fits
        while at < n:
            while token is not None:
                if at + length[token] not in dead:
                    if last < 0:
                        break
                    fit = fits.get(last << 20 | token)
                    if fit is None:
                        fit = self.compatible(last, token)
                    if fit:
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += length[token]
                last, token = token, longest[at]
            else:
                if not out:
                    raise ValueError("the vocabulary can't spell this word")
                dead.add(at)  # so the loop goes on with the next shorter prefix of the token that ends here
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def pretoken_bytes(self, word: str) -> tuple[bytes, bytes]:
        got = self.words.get(word)
        if got is None:
            s = "".join([self.alphabet[b] for b in word.encode()])
            ids = self.encode_symbols(s[:-1] + chr(ord(s[-1]) + self.END))
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            got = self.words[word] = (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids))
        return got

    def decode(self, ids: list[int]) -> bytes:
        """The tokens in order with one space between them: the file names no decoder."""
        blob, offset = self.blob, self.offset
        return b" ".join([blob[offset[i] : offset[i + 1]] for i in ids])

    def holds(self, i: int) -> bool:
        return 0 <= i < self.size and self.offset[i] < self.offset[i + 1]

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers, decoded text in UTF-8) of a whole text."""
        if not text:
            return b"", b""
        if self.at_special is not None and "<|" in text and self.at_special.search(text):
            ids, said, at = [], [], 0
            for m in [*self.at_special.finditer(text), None]:
                a, b = self.encode(text[at : m.start() if m else len(text)])
                ids.append(a)
                said += [b] * bool(a)
                if m:
                    ids.append(struct.pack("<I", self.special[m.group()]))
                    said.append(m.group().encode())
                    at = m.end()
            return b"".join(ids), b" ".join(said)
        if PLAIN.fullmatch(text):
            words = PLAIN_PRETOKEN.findall(text.lower())
        else:
            text = self.normalizer.normalize_str(text)
            words = self.pretoken.findall(text) if AGREED.fullmatch(text) else [w for w, _ in self.splitter.pre_tokenize_str(text)]
        get, one = self.words.get, self.pretoken_bytes
        found = [get(w) or one(w) for w in words]
        return b"".join([a for a, _ in found]), b" ".join([b for _, b in found])


_ENCODERS: dict[str, BacktrackingBPE] = {}


def encoder(path: str) -> BacktrackingBPE:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BacktrackingBPE(path)
    return _ENCODERS[path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Returns id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) and decoded (string).

    One pass without a shuffle. keep_ids and keep_text leave the wide columns out where only the digests are wanted.
    """
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def work(texts: list[str | None]) -> tuple[None, list[pa.Array]]:
        turn("bpe", _ENCODERS.clear)
        got = [encoder(path).encode(t) for t in texts]
        out = [pa.array([len(a) // 4 for a, _ in got], pa.int64()), *(pa.array([hashlib.sha256(x[i]).hexdigest() for x in got], pa.string()) for i in (0, 1))]
        if keep_ids:
            ends = np.cumsum([0, *(len(a) // 4 for a, _ in got)])
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(a for a, _ in got), "<i4"), pa.int32())))
        if keep_text:
            out.append(pa.array([d.decode() for _, d in got], pa.string()))
        return None, out

    return map_texts(docs, id_col, text_col, columns, work).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Returns id and decoded: the text that an array of ids stands for, by the offset table.

    A null or empty array gives the empty text; null ids and ids that the vocabulary lacks are left out, as the
    library does. No shuffle.
    """
    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            texts = [bpe.decode([i for i in ids or () if i is not None and bpe.holds(i)]).decode() for ids in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, decoded string").withColumnRenamed("id", id_col)
