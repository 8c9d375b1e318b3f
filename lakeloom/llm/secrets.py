"""Operator 4, secret scans: fixed patterns plus dictionary-primed zstandard novelty.

The patterns find the base spans.  Beyond them, every long string that follows
a sensitive word closely is a candidate.  Its novelty is what it adds to a
zstandard frame whose dictionary is a list of common identifiers followed by
the text around the candidate: an identifier, a path or a string that the
surroundings repeat costs a few bytes, random key material nearly its length.
Candidates that stay incompressible are reported as kind ``novel``, unless
their letters follow each other as in words.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_column, map_slices, number_columns

# The base patterns, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

# Words that make a following string sensitive.
SENSITIVE_WORDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private", "access_key", "access-key", "accesskey", "signature")
SENSITIVE = re.compile("|".join(SENSITIVE_WORDS), re.I | re.A)
LEAST_LENGTH = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
NAMES = re.compile(r"(?:[A-Za-z0-9+/_.-]*=)+(?=[^=])")
WORD, ALPHABETS = re.compile(r"[A-Za-z]+"), re.compile("abcdef|xxxx", re.I)
KEY_HEADER = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY[A-Z ]{0,10}-----")
#: The last line of a key's body, shorter than a candidate, up to the footer or its padding; line breaks may be escaped or quoted.
LAST_LINE = re.compile(r"""(?:\\[nr]|[\s"'+,|>]){1,32}([A-Za-z0-9+/_]{1,15}(?:={1,2}(?![A-Za-z0-9+/_=])|(?=(?:\\[nr]|[\s"'+,|>]){1,32}-----END)))""")
#: Characters between a sensitive word and a candidate at most; characters of context on each side.
REACH, CONTEXT = 48, 1_024
#: A candidate is reported from this share of its alphabet's bytes and bits of entropy per character on.
LEAST_NOVELTY, LEAST_BITS = 0.8, 3.0
#: A candidate is made of words if letter pairs are this share of it at least and cost fewer bits each than this, given
#: the pairs of identifiers and of the words around it; pairs that aren't in them count as this share of one.
LEAST_PAIRS, LEAST_PAIR_BITS, PAIR_SMOOTHING = 0.5, 4.6, 0.3

# Identifiers that are common in code and configuration.
IDENTIFIERS = " ".join(
    """
    access_token refresh_token client_secret client_id secret_key private_key public_key api_key auth_token
    authorization authentication credentials username password passphrase certificate signature session
    environment configuration production development localhost endpoint function return import include
    static const string integer boolean default public private protected class struct interface namespace
    http https www com org net json yaml html utf-8 sha256 base64 AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY
    GITHUB_TOKEN DATABASE_URL SECRET_KEY_BASE example.com your_token_here changeme placeholder xxxxxxxxxxxxxxxx
    self append error context type name value protocol write header loop format base file default buffer class handler read parse create handle check
    transport items init string exception from dict message thread socket parser option address linux cpython module path close server member content
    version data extended frame values list clear line match remove future traceback register object args sock event pipe time task keys process cache
    code current result selector encode request connection executor start action encoding find reader screen collections shutdown update formatter make
    callback queue startswith done call types info wait flags replace bytes func policy group locale turtle cancel source size winapi manager defect
    readline offset enum errors futures print split lines proactor invalid pending copy lock repr other cookie test headers importlib inspect help wrapper
    load email subprocess method threading local stream search network table actions defects buffered decode count charset filename node registry timeout
    dispatch trace child state domain stack waiter names writer signal sort stdout generator date text long sendfile datetime argument function constants
    logger release part connect events factory precedence cancelled bootstrap running closed send input generic response exceptions level status prefix
    parameter params container simple exit parameters asyncio spec async section join overlapped length ready with handshake complete whitespace work next
    save stats root reading iter coroutine external unix return summary loader tasks strings item logging sslobj directory decoder decimal lineno output
    mode token alias dataclass chars accept last stdin empty first instruction index body visit only received signature special pattern fork windows
    fallback forward hook wrapped proc qualname config short cookies setdefault hash mime fileobj unregister inner handlers indent stderr http flush user
    system safe watcher defaults quoted strict attribute hostname opcode convert wakeup children discard extend parts global origin splitlines description
    console optional readinto callable mapping members filter writing initial platform utils lower machinery kwargs reset verify partial multipart mailbox
    wrap number main callbacks codecs common pickle original resume concurrent endswith client canvas interactive interpolation builtin datagram report
    flag month matcher seek getitem literal allow unhashable select addr notify fileno serving broken boundary disposition float decoded attributes
    compare total control instance required separator record specific param mutable files conflict options chain extract deprecated entry typing acquire
    ratio command configure threads orig functools ignore supports operator opts strip full abstract descriptor bound incremental encoder globals calendar
    missing tuple iterator annotations python proto fields untagged negative validate eager lost guess generate multiprocessing pprint push chunk
    annotation broadcast protocols stop transfer sequence completion helper allowed forever compile reinit limits field ensure recvfrom inst integer
    itertools port down warnings parent comment encoded recv meta invalidation arguments cert terminal import newline break keyword bind style symbol
    subclass target store attrs waiters extension closure mtime usage implementation maybe element tree show finished bases right denominator package
    transports framer barrier proxy called found completed paths finder integral continuation mixin diff unicode temporary popen head terminate impl label
    exclusive adjust build disable symlinks filters tarinfo width excepthook modules inheritable pause sequences reverse opcodes into checked display
    groups commands getsockname difference host zlib urllib counter pool tell case frozen weekday internal iterable decompressor netmask exec waitpid
    dictionary const mutually kind unpack calc builtins recursive matching suppress round anchors compiler finish attr networks insert setter labels
    paused until extra unittest docstring dest partition ascii firstlineno coro winfo timezone maintype importer objc popleft water transp link semaphore
    html warning soon remainder sparse mapped depth poll view metavar reserved named entries printable raise post visible nowait delimiter remote family
    getvalue after encodings translate unstructured executable block partialmethod active prefixes existing condition contains char before calls fold
    positional debug getrandbits pair numbers open outgoing scheduled native symtable tkinter microseconds tokenize locals objclass breaks specified
    sysconfig iana curframe tarfile subclasscheck bare bpbynumber truncate logical normalize major keywords interpreter characters operation limit pickler
    returncode property single marker service prepare choices reduce constructor dataclasses linecache readonly connected removals
    0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 0000000000000000
    """.split()
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, in code points."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _bytes_of(data: bytes, dictionary: zstandard.ZstdCompressionDict | None = None) -> int:
    """Bytes that some data adds to an empty frame."""
    packer = zstandard.ZstdCompressor(level=19, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(packer.compress(data)) - len(packer.compress(b""))


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes of a candidate, given identifiers and its surroundings, per byte of its characters in mixed order.

    The same characters in a fixed mixed order, compressed alone, cost what the
    alphabet and the length let random key material cost: near 1 is random in
    any alphabet, repeats within the candidate count as known.
    """
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + after.encode("utf-8", "replace") + b"\n" + before.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    alone = _bytes_of("".join(random.Random(len(candidate)).sample(candidate, len(candidate))).encode())
    return _bytes_of(candidate.encode(), primed) / alone


def bits_per_character(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _letter_pairs(s: str) -> list[str]:
    """Neighbouring letters in lower case; a capital after a small letter begins a word."""
    return [(a + b).lower() for a, b in zip(s, s[1:]) if a.isalpha() and b.isalpha() and not (a.islower() and b.isupper())]


_PAIRS = Counter(p for w in IDENTIFIERS.decode().split() if not ALPHABETS.search(w) for p in _letter_pairs(w))


def _worded(s: str, before: str, after: str) -> bool:
    """Whether a string's letters follow each other as in identifiers and in the words around it; random letters rarely do.

    A short frame stores an identifier that no dictionary has whole as it stores
    a key, so the compressor can't tell these two apart.
    """
    own = _letter_pairs(s)
    if len(own) < LEAST_PAIRS * len(s):
        return False
    pairs = Counter(_PAIRS)
    for w in WORD.findall(CANDIDATE.sub(" ", f"{before} {after}")):
        pairs.update(_letter_pairs(w))
    first: Counter[str] = Counter()
    for pair, n in pairs.items():
        first[pair[0]] += n
    bits = sum(-math.log2((pairs[p] + PAIR_SMOOTHING) / (first[p[0]] + 26 * PAIR_SMOOTHING)) for p in own)
    return bits < LEAST_PAIR_BITS * len(own)


def _sensitive_places(text: str) -> list[tuple[int, int]]:
    """(first, last) places where a candidate may begin, by first place: close after a sensitive word, anywhere in a private key's body."""
    places = [(m.end(), m.end() + REACH) for m in SENSITIVE.finditer(text)]
    headers = list(KEY_HEADER.finditer(text))
    for m, upper in zip(headers, [h.start() for h in headers[1:]] + [len(text)]):
        end = text.find("-----END", m.end(), upper)
        places.append((m.end(), end if end >= 0 else m.end() + REACH))
    return sorted(places)


def novel_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of incompressible strings in a sensitive context that no base span touches.

    A line break does not end a context, and each reported string is one for the
    runs that follow it, so all lines of a key's body are found; so is its short
    last line.
    """
    lowered = text.lower()
    if not any(word in lowered for word in SENSITIVE_WORDS):
        return []
    found: dict[int, tuple[int, int, int]] = {}
    tried: set[int] = set()
    merged: list[list[int]] = []
    for a, _, b in sorted(taken):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    begins = [a for a, _ in merged]

    def touches(start: int, end: int) -> bool:
        at = bisect_left(begins, end)
        return at > 0 and merged[at - 1][1] > start

    places = _sensitive_places(text)[::-1]  # a stack: a reported string's own context comes next
    while places:
        first, last = places.pop()
        for m in CANDIDATE.finditer(text, first, min(len(text), last + 16)):
            start = m.start()
            if start > last or start in tried:
                continue
            tried.add(start)
            end = CANDIDATE.match(text, start).end()  # whole, also beyond the reach
            if start and text[start - 1] == "\\" and text[start] in "nrt" and end - start > LEAST_LENGTH:
                start += 1  # the letter of an escape
            if names := NAMES.match(text, start, end):
                start = names.end()  # what is left of the name that the value is assigned to
            s = text[start:end]
            if len(s) < LEAST_LENGTH or bits_per_character(s) < LEAST_BITS or touches(start, end):
                continue
            before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
            if novelty(s, before, after) >= LEAST_NOVELTY and not _worded(s, before, after):
                found[start] = (start, 3, end)
                places.append((end, end + REACH))
                tail = LAST_LINE.match(text, end)
                if tail and not touches(tail.start(1), tail.end(1)):
                    found[tail.start(1)] = (tail.start(1), 3, tail.end(1))
    return sorted(found.values())


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, spans array<struct<kind, start, end, value>> by start, then kind.

    Positions are code points, ends exclusive.  Null and empty texts have no
    spans; repeated rows and null ids are carried; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(slices):
        for part in slices:
            spans = []
            for text in part["text"]:
                text = text or ""
                base = base_spans(text)
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in sorted(base + novel_spans(text, base))])
            yield {"doc_id": part["doc_id"], "spans": spans}

    return map_slices(docs, f"doc_id {id_type}, spans array<struct<kind: string, start: long, end: long, value: string>>", {"doc_id": id_col, "text": text_col}, scan)


def mask(text: str) -> str:
    """The text with every secret replaced by a mark of its kind; overlapping spans become one."""
    base = base_spans(text)
    merged: list[list[int]] = []
    for a, k, b in sorted(base + novel_spans(text, base)):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    out, at = [], 0
    for a, k, b in merged:
        out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join([*out, text[at:]]) if out else text


def masked(text: Column) -> Column:
    """The text with its secrets masked; null texts stay null.  Only changed texts come back from Python."""

    def run(texts: list) -> list:
        found = [t if t is None else mask(t) for t in texts]
        return [None if new == old else new for new, old in zip(found, texts)]

    return F.coalesce(map_column(text, "string", run), text)


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, whatever their names, with secrets masked in the text."""
    numbered, names = number_columns(docs)
    return numbered.withColumn(names[text_col], masked(F.col(names[text_col]))).toDF(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
