"""Operator 2, BPE encoding and decoding: per-prefix dynamic programming.

The encoding of a word is found without replaying its merges.  A token sequence
is the encoding exactly if each token is the encoding of its own symbols and no
merge would have crossed the boundary of two neighbours.  So each prefix of a
word has one last token: the vocabulary entry that ends there (an automaton
lists all of them in one pass) and is compatible with the last token of the
prefix before it.  Following these back-pointers from the end gives the ids.

Two neighbours are compatible if no pair of nodes along the boundary (the right
edge of the left token's merge tree, the left edge of the right token's) has a
merge that comes before both nodes are merged into their own parents.

Words are cut out of the text as the tokenizer file says: normalisation and the
splitting pattern are its own; added tokens are taken out of the raw text first.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_slices
from .tokenizer import WHITE_SPACE, ChunkCache, byte_symbols

WORD = re.compile(f"[^{WHITE_SPACE}]+")
#: Entries of the cache of compatible pairs; it starts anew when full.
CACHE_PAIRS = 1_000_000
#: Runs of one generation of the cache of encoded runs.
CACHE_RUNS = 350_000
#: Added to a symbol that ends a word, for vocabularies that mark word ends.
END = 0x10000


class BpeModel:
    """Vocabulary, merges and automaton of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        splits = [p["pattern"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.pattern = splits[0].get("Regex") if len(splits) == 1 else None
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.symbols = byte_symbols()

        vocab = model["vocab"]
        self.merges: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            whole = vocab[left + right]
            self.merges.setdefault((a, b), rank)
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, (a, b)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token not in self.added:
                key = self._marked(token)
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges_left: dict[int, list[tuple[int, float]]] = {}
        self.edges_right: dict[int, list[tuple[int, float]]] = {}
        self.whole: dict[int, bool] = {}

    def _marked(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + END)
        return token

    def _edge(self, token: int, side: int, memo: dict) -> list[tuple[int, float]]:
        """Nodes along one edge of a token's merge tree, each with the rank of the merge that ends it."""
        found = memo.get(token)
        if found is None:
            found, limit, t = [], float("inf"), token
            while True:
                found.append((t, limit))
                if t not in self.parts:
                    break
                limit, t = self.rank[t], self.parts[t][side]
            memo[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether these tokens stay apart when their symbols stand side by side.

        Of equal merges the leftmost is done first, so a merge within the left
        token wins a tie against the crossing one, and the crossing one against
        a merge within the right token.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            merges = self.merges
            known = True
            for a, a_end in self._edge(left, 1, self.edges_right):
                for b, b_end in self._edge(right, 0, self.edges_left):
                    rank = merges.get((a, b))
                    if rank is not None and rank < a_end and rank <= b_end:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _is_own_encoding(self, token: int) -> bool:
        """Whether a token is what its own symbols are merged to."""
        known = self.whole.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = parts is None or (self._is_own_encoding(parts[0]) and self._is_own_encoding(parts[1]) and self._first_merge_holds(token))
            self.whole[token] = known
        return known

    def _first_merge_holds(self, token: int) -> bool:
        a, b = self.parts[token]
        top = self.rank[token]
        for x, x_end in self._edge(a, 1, self.edges_right):
            for y, y_end in self._edge(b, 0, self.edges_left):
                rank = self.merges.get((x, y))
                if rank is not None and (x, y) != (a, b) and rank < min(x_end, top) and rank <= min(y_end, top):
                    return False
        return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as byte symbols; raises KeyError if a symbol is not in the vocabulary."""
        if self.suffix:
            word = word[:-1] + chr(ord(word[-1]) + END)
        n = len(word)
        last: list[int] = [-1] * (n + 1)
        back = [0] * (n + 1)
        compatible = self.compatible
        for at, (token, size) in self.automaton.iter(word):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            if not self._is_own_encoding(token):
                continue
            if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                last[end], back[end] = token, start
        ids, at = [], n
        while at:
            if last[at] < 0:
                raise KeyError(f"no token ends at symbol {at} of {word!r}")
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def words(self, chunk: str) -> list[str]:
        """The words of a text without added tokens, as byte symbols."""
        if self.normalizer is not None:
            chunk = self.normalizer.normalize_str(chunk)
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(chunk)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, added tokens included where their strings stand."""
        ids, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            ids += self._plain(text[at : m.start()])
            ids.append(self.added[m[0]])
            at = m.end()
        return ids + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        return [i for w in (self.words(text) if text else ()) for i in self.encode_word(w)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included, as the file's decoder says."""
        if not self.byte_decoder:
            return " ".join(self.tokens[i] for i in ids)
        of = {s: b for b, s in enumerate(self.symbols)}
        out = b"".join(bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in (self.tokens[i] for i in ids))
        return out.decode("utf-8", "replace")


class WordEncoder:
    """Texts to ids and back, each distinct run of non-space characters once.

    No word of the pattern contains white space, so the runs encode apart.  Runs
    of ASCII and Latin-1 letters, which normalisation only puts in lower case,
    are cut into words here, and their words are remembered, too; all other
    runs go through the file's own normaliser and pattern.
    """

    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    # The splitting pattern of the file, on lower-case ASCII and Latin-1.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        self.model = model = BpeModel(path)
        lowers = model.normalizer is not None and model.normalizer.normalize_str("AZ\u00c9") == "az\u00e9"
        self.lowers = lowers and model.pattern == self.PATTERN
        self.of_char = {c: "".join(model.symbols[b] for b in chr(c).encode()) for c in range(256)}
        self.known_words = ChunkCache(self._word, CACHE_RUNS)
        self.cache = ChunkCache(self._run, CACHE_RUNS)

    def _word(self, word: str) -> tuple[str, str]:
        ids = self.model.encode_word(word.translate(self.of_char))
        return " ".join(map(str, ids)), self.model.decode(ids)

    def _run(self, run: str) -> tuple[str, str]:
        if self.lowers and self.PLAIN.fullmatch(run) and not (self.model.special and self.model.special.search(run)):
            words = self.WORDS.findall(run.lower())
            if len(words) == 1:
                return self.known_words.look_up(words)[0]
            got = self.known_words.look_up(words)
            return " ".join([g[0] for g in got]), " ".join([g[1] for g in got])
        ids = self.model.encode(run)
        return " ".join(map(str, ids)), self.model.decode(ids)

    def encode(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by a space, decoded text) of a text."""
        got = self.cache.look_up(WORD.findall(text))
        return " ".join([g[0] for g in got if g[0]]), " ".join([g[1] for g in got if g[0]])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, ids (decimal, joined by a space), decoded.

    For tokenizer files whose words never contain white space and whose decoder
    joins tokens by a space.  Null and empty texts have no ids and decode to the
    empty text; texts of any length are encoded whole; repeated rows and null
    ids are carried; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(slices):
        for rows in slices:
            encoder = word_encoder(tokenizer_path)
            got = [encoder.encode(t or "") for t in rows["text"]]
            yield {"doc_id": rows["doc_id"], "ids": [g[0] for g in got], "decoded": [g[1] for g in got]}

    return map_slices(docs, f"doc_id {id_type}, ids string, decoded string", {"doc_id": id_col, "text": text_col}, run)


def op2_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = bpe_encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.translate("ids", " ", "")) + 1)
    return got.select(
        "doc_id",
        n.cast("long").alias("n_tokens"),
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
