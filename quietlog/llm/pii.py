"""Personal data by exact forms and by contexts learnt from them.

Seeds are found by exact rules.  The words around them induce lexical patterns; patterns and the
identifiers that occur in them form a graph in which Spark scores both sides in turn; patterns
of high confidence then mark identifiers that no rule knows.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.common import column, slices, texts
from quietlog.session import scratch_dir
from quietlog.sources.tables import materialise

KINDS = ("email", "ip", "card", "phone")
CHUNK_BYTES = 4 << 20
#: Rounds of scoring, and what a pattern needs: distinct seeds, and the share of its identifiers that are of the kind.
ROUNDS, SEEDS, CONFIDENCE = 3, 5, 0.8

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits could not succeed where the run's first digit failed.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
#: Signs around an identifier that do not belong to it.
_AROUND = "\"'.,;:!?()[]{}<>"
#: Groups of digits with spaces or brackets between them, as numbers that are called or paid with are written.
_GROUPED = re.compile(r"(?<!\w)\(?[0-9][0-9()\x20.-]*[0-9](?!\w)")
_GROUPED_DIGITS = range(7, 20)
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Longer words of a context, and longer identifiers, are known by their digests.
_LONG_WORD, _LONG_VALUE = 40, 200


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; every step is linear in the text."""
    spans = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                spans.append(("email", start, m.end()))
                free = m.end()
    if not any(d in text for d in "0123456789"):
        return spans
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups()):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


def _short(word: str, most: int) -> str:
    return word if len(word) <= most else hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def _word(word: str) -> str:
    """A word of a context: numbers in it are all alike."""
    return _short(_DIGITS.sub("9", word), _LONG_WORD)


def shape(value: str) -> str:
    """How an identifier is built: runs of letters and of digits as one sign each, other signs as they are."""
    return _short(_LETTERS.sub("a", _DIGITS.sub("9", value)), _LONG_WORD)


def contexts(text: str, spans: list[tuple[str | None, int, int]]) -> list[list[str]]:
    """Lexical patterns around each of the spans (kind, start, end).

    Two words before it; the word before and the word behind; the word before alone; the word before with the
    span's own shape.  Another span among these words stands there as its kind and ends the context, so
    all contexts together are linear in the text.
    """
    order = sorted(range(len(spans)), key=lambda i: spans[i][1:])
    name = lambda i: f"<{spans[i][0] or 'id'}>"
    found: list[list[str]] = [[]] * len(spans)
    reach, last = 0, None
    for i, behind in zip(order, [*order[1:], None]):
        _, start, end = spans[i]
        left = [_word(w) for w in text[min(reach, start):start].lower().rsplit(None, 2)[-2:]]
        if len(left) < 2 and last is not None:
            left = [name(last), *left]
        limit = len(text) if behind is None else max(end, spans[behind][1])
        right = [_word(w) for w in text[end:limit].lower().split(None, 1)[:1]]
        if not right and behind is not None:
            right = [name(behind)]
        own = []
        if left:
            own += [f"{left[-1]} _", f"{left[-1]} _ {shape(text[start:end].lower())}"]
        if len(left) == 2:
            own.append(f"{left[0]} {left[1]} _")
        if left and right:
            own.append(f"{left[-1]} _ | {right[0]}")
        found[i] = own
        if end >= reach:
            reach, last = end, i
    return found


def _apart(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of the others; both sorted by start."""
    free, k, reach = [], 0, 0
    for a, b in spans:
        while k < len(others) and others[k][0] < b:
            reach = max(reach, others[k][1])
            k += 1
        if reach <= a:
            free.append((a, b))
    return free


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans of other identifiers, apart from those taken.

    Groups of 7 to 19 digits with spaces or brackets; words with a digit or an at sign, five
    characters or more, without the signs around them and without a name before ``=`` or ``:``.
    """
    if not ("@" in text or _DIGIT.search(text)):
        return []
    used = sorted((a, b) for _, a, b in taken)
    grouped = [m.span() for m in _GROUPED.finditer(text)
               if (" " in m[0] or "(" in m[0]) and len(_DIGIT.findall(m[0])) in _GROUPED_DIGITS]
    found = _apart(grouped, used)
    words = [m.span() for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]) or "@" in m[0]]
    for start, end in _apart(words, sorted([*used, *found])):
        word = text[start:end]
        head = max(word.rfind("="), word[:-1].rfind(":")) + 1  # name=value, name:value
        body = word[head:]
        a = start + head + len(body) - len(body.lstrip(_AROUND))
        body = body.strip(_AROUND)
        if len(body) >= 5 and (_DIGIT.search(body) or "@" in body):
            found.append((a, a + len(body)))
    return sorted(found)


_SPAN = "struct<kind:string,start:long,end:long>"
_USE = "struct<kind:string,start:long,end:long,value:string,patterns:array<string>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_USES = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _first_pass(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, mark, spans, uses): base spans, and every identifier with its patterns (kind null if no rule knows it)."""
    def run(batches):
        for batch in slices(batches, CHUNK_BYTES):
            own = texts(batch)
            spans, uses = [], []
            for text in own:
                base = base_spans(text)
                every = [*base, *((None, a, b) for a, b in candidates(text, base))]
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in base])
                uses.append([
                    {"kind": kind, "start": a, "end": b, "value": _short(text[a:b].lower(), _LONG_VALUE), "patterns": around}
                    for (kind, a, b), around in zip(every, contexts(text, every))])
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("mark")),
                pa.array(spans, _SPANS), pa.array(uses, _USES)], ["doc_id", "mark", "spans", "uses"])

    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    schema = f"doc_id long, mark long, spans array<{_SPAN}>, uses array<{_USE}>"
    path = scratch_dir(spark, "pii")
    rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.schema(schema + ", row long").parquet(path)


def learnt_patterns(uses: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows (pattern, kind, confidence) that may mark unknown identifiers.

    ``uses`` has rows (kind, value, pattern).  A pattern's confidence in a kind is the score of its distinct
    values over their number plus one; a value's score is the chance that not all its
    patterns err.  Known values keep score one.  Counts are of distinct values, so a passage
    that is copied a thousand times counts once.
    """
    edges = materialise(uses.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"), *(
        F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS))
    most = F.greatest(*KINDS)
    # a pattern that no seed supports enough can not reach the threshold: it takes no part
    sizes = materialise(sizes.where(most >= 2), "pii-patterns")
    edges = edges.join(sizes.select("pattern", "n"), "pattern")
    known = edges.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    scores = known
    for step in range(rounds):
        rated = edges.drop("kind").join(scores, "value").groupBy("pattern", "kind").agg(
            (F.sum("score") / (F.first("n") + 1)).alias("confidence"))
        rated = materialise(rated, "pii-rated")
        if step < rounds - 1:
            doubt = F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.99))))
            spread = edges.where("kind is null").drop("kind").join(rated.where("confidence >= 0.5"), "pattern")
            scores = materialise(known.union(
                spread.groupBy("value", "kind").agg((F.lit(1.0) - F.exp(doubt)).alias("score"))), "pii-scores")
    support = sizes.select("pattern", F.explode(F.array(*(
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("seeds")) for k in KINDS))).alias("s")).select("pattern", "s.kind", "s.seeds")
    return rated.where(F.col("confidence") >= confidence).join(support.where(F.col("seeds") >= seeds), ["pattern", "kind"]).select(
        "pattern", "kind", "confidence")


def detect(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, mark, spans, found): base spans and spans found by context, one row per document.

    A null text is an empty one and has no spans.  Repeated rows and null doc_ids come out as they
    come in.  ``mark`` is a hash of the text.
    """
    first = _first_pass(docs)
    uses = first.select("row", F.explode("uses").alias("u")).select("row", "u.*")
    narrow = uses.select("kind", "value", F.explode("patterns").alias("pattern"))
    good = learnt_patterns(narrow)
    unknown = uses.where("kind is null").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    new = unknown.join(good, "pattern").groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    new = new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))
    return first.drop("uses").join(new, "row", "left").withColumn(
        "found", F.coalesce("found", F.array().cast(f"array<{_SPAN}>")))


def digests(detected: DataFrame) -> DataFrame:
    """Counts per kind of the base spans, their digest, and all spans as a string."""
    def run(batches):
        place = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            base, found = column(batch, "spans"), column(batch, "found")
            line = lambda spans: ",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(
                (place[s["kind"]], s["start"], s["end"], s["kind"]) for s in spans))
            counts = [pa.array([sum(s["kind"] == k for s in spans) for spans in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")), *counts,
                pa.array([hashlib.sha256(line(b).encode()).hexdigest() for b in base], pa.string()),
                pa.array([line([*b, *f]) for b, f in zip(base, found)], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return detected.select("doc_id", "spans", "found").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span as ``[KIND]``; overlapping spans become one, of the kind that starts first."""
    parts, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans replaced in the texts, and n_chars counted anew where a text changed; all rows stay.

    Exact forms are found where the text is; only spans found by context, a small table of known size,
    are joined to the documents.
    """
    mark, doc, marks = (next(n for n in (name + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
                        for name in ("pii_mark", "pii_doc", "pii_spans"))  # names that no column has
    found = detect(docs).where("size(found) > 0").select(
        F.col("mark").alias(mark), F.col("doc_id").alias(doc), F.col("found").alias(marks))
    found = materialise(found.dropDuplicates([mark, doc]), "pii-found")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(found, (F.xxhash64(text) == F.col(mark)) & docs["doc_id"].cast("long").eqNullSafe(F.col(doc)), "left")
    joined = joined.drop(mark, doc)

    def run(batches):
        for batch in slices(batches, CHUNK_BYTES):
            own, spans = column(batch, "text"), column(batch, marks)
            spans = [[(a, b, kind) for kind, a, b in base_spans(t or "")] + [(s["start"], s["end"], s["kind"]) for s in x or ()]
                     for t, x in zip(own, spans)]
            new = [redact(t, x) if x else t for t, x in zip(own, spans)]
            arrays = dict(zip(batch.schema.names, batch.columns))
            arrays["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in arrays:
                kind = batch.schema.field("n_chars").type
                arrays["n_chars"] = pa.array([len(t) if x else n for t, x, n in zip(new, spans, arrays["n_chars"].to_pylist())], kind)
            del arrays[marks]
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return joined.mapInArrow(run, docs.schema)
