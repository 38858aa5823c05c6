"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty for strings that no pattern names.

A candidate near a sensitive word, on either side, or next to a reported one is priced by what it adds to the compressed size of
its surroundings, under a dictionary: what code commonly holds, and the parts of words and identifiers that most texts of the
table hold. The same characters in another order set the scale: they cost what a random string of that alphabet and
length costs. Words, paths and identifiers cost much less than their jumble; random keys cost as much, however long they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from math import gcd

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What may lie between the lines of one secret: white space, quotes, line ends in source code.
_ADJOINS = re.compile(r"""(?:\\[nr]|[\s"'+,;>|*#\\]){1,64}""")
_SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|credential|private|bearer|signature|session", re.I | re.A)
_HINTS = ("key", "secret", "token", "passw", "pwd", "auth", "credential", "private", "bearer", "signature", "session")
#: How many parts the dictionary has at most: those in most texts, in at least SEVERAL.
PARTS, SEVERAL = 2000, 3
#: A part: letters of one case, or of lower case behind a capital. Random strings hold only short ones.
_PART = "[A-Z]?[a-z]{2,13}|[A-Z]{3,14}"
#: Characters of context on either side, and the marginal cost that is reported: in all, and as a share of the jumble's.
CONTEXT, LEAST_BYTES, LEAST_RATIO = 64, 14, 0.85

# Text that code and configuration commonly hold, as the compressor's dictionary.
_DICTIONARY = """
import from return function const class public private static void string integer boolean false true null none undefined
if else elif for while try except finally raise throw catch new this self super def lambda async await yield with as not and or
password passwd secret token api_key apikey access_key secret_key client_id client_secret private_key public_key
authorization bearer basic session cookie signature credential credentials username account user admin root localhost
example.com http:// https:// www. .com .org .net /usr/local/bin /home/user/ /var/lib/ /etc/config application/json text/html
content-type user-agent accept-encoding getElementById addEventListener createElement document window console.log
SELECT FROM WHERE INSERT INTO VALUES UPDATE DELETE JOIN GROUP BY ORDER BY CREATE TABLE PRIMARY KEY
ConfigurationManager AbstractFactory ServiceProvider RequestHandler ResponseWriter DatabaseConnection AuthenticationToken
BEGIN RSA PRIVATE KEY END PRIVATE KEY BEGIN CERTIFICATE END CERTIFICATE ssh-rsa
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef
xxxxxxxxxxxxxxxx ---------------- ================ ________________ ++++++++++++++++ ////////////////
your_api_key_here changeme placeholder example_token test_secret dummy sample default environment variable
"""


class Novelty:
    """Marginal compressed bytes of a candidate inside its context."""

    def __init__(self, learned: str = "", level: int = 9):
        raw = zstandard.ZstdCompressionDict(f"{learned}\n{_DICTIONARY}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)

    def cost(self, before: str, candidate: str, after: str) -> int:
        sizes = [len(self.compressor.compress(x.encode("utf-8", "surrogatepass"))) for x in (before + candidate + after, before + after)]
        return sizes[0] - sizes[1]

    def is_novel(self, before: str, candidate: str, after: str) -> bool:
        cost = self.cost(before, candidate, after)
        return cost >= LEAST_BYTES and (cost >= LEAST_RATIO * len(candidate) or cost >= LEAST_RATIO * self.cost(before, jumbled(candidate), after))


def jumbled(text: str) -> str:
    """The same characters, each about 0.38 of the length behind the one before: nothing of three characters stays together."""
    step = max(1, int(len(text) * 0.381966))
    while gcd(step, len(text)) > 1:
        step += 1
    return "".join(text[i * step % len(text)] for i in range(len(text)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, leftmost and not overlapping within each kind."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if _ASSIGN_HINT.search(text) else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


_ASSIGN_HINT = re.compile(r"[:=]")


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that the dictionary and the surroundings do not explain and no base span covers."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    every = [(m.start(), m.end()) for m in _CANDIDATE.finditer(text)]
    if not every:
        return []
    starts, ends = [s for s, _ in every], [e for _, e in every]
    closed = _joined(taken)
    tried: set[tuple[int, int]] = set()
    found: list[tuple[int, int, int]] = []

    def covered(s: int, e: int, spans: list, at: int) -> bool:
        """Whether one of the disjoint ascending spans next to a place overlaps s to e."""
        return any(x[0] < e and s < x[-1] for x in spans[max(0, at - 1) : at + 1])

    def price(s: int, e: int) -> None:
        """Report a candidate that costs enough, then try those that adjoin it."""
        todo = [(s, e)]
        while todo:
            s, e = todo.pop()
            at = bisect_left(found, (s, 3, e))
            if (s, e) in tried or covered(s, e, found, at) or covered(s, e, closed, bisect_left(closed, (s, e))):
                continue
            tried.add((s, e))
            before, after = (_CANDIDATE.sub(" ", x) for x in (text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]))  # other candidates would make the compressor cheap for random text
            if not novelty.is_novel(before, text[s:e], after):
                continue
            found.insert(at, (s, 3, e))
            right, left = bisect_left(starts, e), bisect_right(ends, s) - 1
            if right < len(every) and _ADJOINS.fullmatch(text, e, starts[right]):
                todo.append(every[right])
            if left >= 0 and _ADJOINS.fullmatch(text, ends[left], s):
                todo.append(every[left])

    seen = last = 0
    for word in _SENSITIVE.finditer(text):
        for i in range(bisect_left(ends, word.start() - CONTEXT), bisect_left(starts, word.start())):
            s = max(starts[i], last) if ends[i] > word.start() else starts[i]  # of a run that holds several sensitive words what lies between them
            if min(ends[i], word.start()) - s >= 16:
                price(s, min(ends[i], word.start()))
        last = word.end()
        for m in _CANDIDATE.finditer(text, max(word.end(), seen), word.end() + 3 * CONTEXT):
            s = m.start()
            if s > word.end() + CONTEXT:
                break
            seen = e = _CANDIDATE.match(text, s).end()  # the searched region may end inside it
            price(s, e)
    return found


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans in order of start as disjoint ones."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def learn_dictionary(docs: DataFrame, text_col: str = "text") -> str:
    """Parts of words and identifiers that at least SEVERAL different texts of all hold, the PARTS most common ones.

    Every text is read; copies, told by their hash, count once, and only a text's parts are shuffled. Null and empty texts and
    texts without such parts add nothing; an empty table gives an empty dictionary. Other columns are not read.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text > ''")
    held = F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit(_PART), F.lit(0))), " ")  # in one string, half as long as an array in a shuffle
    single = texts.select(F.xxhash64("text").alias("h"), held.alias("held")).groupBy("h").agg(F.any_value("held").alias("held"))
    parts = single.where("held > ''").select(F.explode(F.split("held", " ")).alias("part"))
    rows = parts.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= SEVERAL).orderBy(F.desc("n"), "part").limit(PARTS).collect()
    return " ".join(r.part for r in reversed(rows))


def scan_secrets(docs: DataFrame, dictionary: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of likely secrets in whole texts: doc_id, kinds, starts, ends (arrays, in order of start, then kind).

    `dictionary` holds learned parts, as of `learn_dictionary`. Offsets are code points, ends exclusive. Null and empty texts
    have no spans, an empty table no rows. Repeated rows, null ids and ties give a row each. Texts of any length are scanned
    whole, in time that grows with their length. Other columns are not read, whatever their names.
    """
    bounded_batches(docs.sparkSession)

    def scanned(batches):
        novelty = Novelty(dictionary)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text) if text else []
                rows.append(sorted(base + novel_spans(text, base, novelty)) if text else [])
            kinds = pa.array([[KINDS[k] for _, k, _ in r] for r in rows], pa.list_(pa.string()))
            ends = [pa.array([[x[i] for x in r] for r in rows], pa.list_(pa.int64())) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), kinds, *ends], names=["doc_id", "kinds", "starts", "ends"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scanned, "doc_id long, kinds array<string>, starts array<long>, ends array<long>")


def digest(spans: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans as one string."""
    every = F.arrays_zip("kinds", "starts", "ends")

    def joined(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("kinds", lambda x: x == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    base = F.filter(every, lambda s: s["kinds"] != KINDS[3])
    return spans.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))
