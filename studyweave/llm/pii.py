"""Personal data: base patterns and information-theoretic sanitisation.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. They are the protected
entities. A term discloses an entity if knowing the term leaves little of the entity's information: with
PMI(e; t) = log2 p(t | e) / p(t) over the corpus, term t discloses e where PMI(e; t) >= ALPHA * IC(e),
IC(e) = -log2 p(e). p(t) and p(e) are shares of all lines; p(t | e) is the share of e's distinct lines that
hold t, so copies of a document are no evidence. A context is the whole line, and a pair needs SUPPORT of them.
A line holds the terms that stand anywhere in it, inside personal data too: a name in an address is a term like
any other. Disclosing terms become spans of kind ``term`` in documents that hold the entity; base spans stay. All
counts are exact and cover every line of every document.

Defined cases: null text is empty (no spans); base matches that fail their check are dropped and not retried;
terms inside or across base spans are not marked; rows that repeat a doc_id or have none stay separate; an
empty table gives an empty result; input columns of any name are kept by :func:`sanitise_documents`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bound_batches, free_name, hand_back, materialise, maybe_broadcast, remove, table_path

#: Share of an entity's information content that a term must reveal, and distinct contexts that show it.
ALPHA = 0.9
SUPPORT = 3
#: A term: a run of characters but for ASCII and Latin-1 signs, digits, punctuation and symbols. Shorter words reveal
#: nothing by themselves. Ranges are written out so that Java and Python read the same terms.
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\xA9\\xAB-\\xB4\\xB6-\\xB9\\xBB-\\xBF\\xD7\\xF7\\u2000-\\u206F\\u20A0-\\u2BFF\\u2E00-\\u2E7F\\u3000-\\u303F\\uFE30-\\uFE6F\\uFF00-\\uFF20\U0001F000-\U0001FAFF]{3,}"

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NON_DIGIT = re.compile("[^0-9]+")
_HINT = re.compile("[@+0-9]")
#: What each kind is generalised to.
MASKS = {"email": "[email]", "ip": "[ip]", "card": "[card]", "phone": "[phone]", "term": "[term]"}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each '@': no start inside a run of local characters can do better than its first."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", domain.end() if domain else at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    if not _HINT.search(text):
        return []
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NON_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _found(whole: bool):
    """Per document: the lines that hold entities, by the hash of their text, with these or, if whole, their terms."""
    kinds = pa.list_(pa.struct([("line", pa.int64()), ("held", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(TERM)
        for batch in batches:
            contexts = []
            for value in batch.column("text"):
                text = value.as_py()
                rows, spans, k = [], base_spans(text), 0
                while k < len(spans):
                    low, high = text.rfind("\n", 0, spans[k][0]) + 1, text.find("\n", spans[k][1])
                    high, first = high if high >= 0 else len(text), k
                    while k < len(spans) and spans[k][0] < high:
                        k += 1
                    held = {w.lower() for w in word.findall(text, low, high)} if whole else {f"{kind}:{text[a:b].lower()}" for a, b, kind in spans[first:k]}
                    key = int.from_bytes(hashlib.blake2b(text[low:high].encode(), digest_size=8).digest(), "little", signed=True)
                    rows.append({"line": key, "held": sorted(held)})
                contexts.append(rows)
            yield pa.RecordBatch.from_arrays([pa.array(contexts, kinds)], ["contexts"])
            hand_back()

    return run


def _contexts(texts: DataFrame, whole: bool) -> DataFrame:
    found = texts.where(F.col("text").rlike("[@+0-9]")).mapInArrow(_found(whole), "contexts array<struct<line: long, held: array<string>>>")
    return found.select(F.explode("contexts").alias("c")).select("c.*")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def disclosing_terms(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(entity, terms): what discloses each entity, by co-occurrence over all lines of all documents.

    Whole lines move only where they can matter: entities need ``support`` distinct lines, and as p(t | e) is 1 at
    most, a term that is in more than p(e) ** alpha of all lines (an entity's bound) cannot disclose it.
    """
    bound_batches(docs.sparkSession)
    texts = _texts(docs).select("text")
    hits = _contexts(texts, False).select("line", F.explode("held").alias("entity")).groupBy("entity", "line").agg(F.count("*").alias("times"))
    hits = all_hits = materialise(hits, "contexts")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    total = F.lit(texts.agg(F.sum(breaks + 1).alias("n")).first().n or 0).cast("double")
    share = F.least(F.lit(1.0), F.col("times") / total)
    per_entity = hits.groupBy("entity").agg(F.count("*").alias("n_entity"), F.sum("times").alias("times")).where(F.col("n_entity") >= support)
    per_entity = materialise(per_entity.withColumn("bound", total * F.pow(share, F.lit(alpha)) * 1.000001), "entities")
    strong, size = per_entity.agg(F.count("*"), F.sum(F.length("entity") + 48)).first()
    if not strong:
        remove(docs.sparkSession, table_path(all_hits), table_path(per_entity))
        return docs.sparkSession.createDataFrame([], "entity string, terms array<string>")
    hits = materialise(hits.select("entity", "line").join(maybe_broadcast(per_entity.select("entity", "bound"), strong, size / strong), "entity"), "strong")
    keep = materialise(hits.groupBy("line").agg(F.max("bound").alias("most")), "lines")
    # each distinct line once, with its terms
    held = _contexts(texts, True).join(maybe_broadcast(keep, keep.count()), "line").groupBy("line").agg(F.first("held").alias("held"), F.first("most").alias("most"))
    line_terms = materialise(held, "line-terms")
    held = line_terms.select("line", "most", F.explode("held").alias("term"))
    wanted = materialise(held.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("term"), "wanted")
    # every line of the corpus counts for the terms that could disclose something; sums are made before the shuffle
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"))
    found = F.array_join(F.regexp_extract_all("line", F.lit(TERM), F.lit(0)), "\n")  # each term is put in lower case by itself
    words = lines.select(F.explode(F.array_distinct(F.split(F.lower(found), "\n"))).alias("term"))
    few = wanted.count() * 48 <= BROADCAST_BYTES
    words = (words.join(F.broadcast(wanted), "term", "left_semi") if few else words).groupBy("term").agg(F.count("*").alias("n_term"))
    spread = materialise(words if few else words.join(wanted, "term", "left_semi"), "spread")
    rare = held.join(maybe_broadcast(spread, spread.count(), 56), "term").where(F.col("n_term") <= F.col("most"))
    pairs = rare.select("line", "term", "n_term").join(hits, "line").where(F.col("n_term") <= F.col("bound"))
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term")).where(F.col("n_both") >= support)
    scored = together.join(maybe_broadcast(per_entity, strong, size / strong), "entity")
    pmi = F.log2(F.col("n_both") / F.col("n_entity") * total / F.col("n_term"))
    content = -F.log2(share)
    result = materialise(scored.where(pmi >= alpha * content).groupBy("entity").agg(F.sort_array(F.collect_set("term")).alias("terms")), "disclosing")
    remove(docs.sparkSession, *(table_path(t) for t in (all_hits, per_entity, hits, keep, line_terms, wanted, spread)))
    return result


def all_spans(text: str, terms: list[str] | None) -> tuple[list, list]:
    """(base spans, those and the spans of disclosing terms outside them)."""
    base = base_spans(text)
    if not terms:
        return base, base
    taken, wanted, k = sorted((a, b) for a, b, _ in base), set(terms), 0
    more = []
    for m in re.finditer(TERM, text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if m[0].lower() in wanted and not any(a < m.end() and m.start() < b for a, b in taken[k : k + 8]):
            more.append((*m.span(), "term"))
    return base, sorted(base + more, key=lambda s: (s[0], (*KINDS, "term").index(s[2])))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, terms in zip(batch.column("text"), batch.column("terms")):
            text = text.as_py()
            base, spans = all_spans(text, terms.as_py())
            rows.append([sum(s[2] == kind for s in base) for kind in KINDS] + [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), sanitise(text, spans)])
        columns = list(zip(*rows)) if rows else [()] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean_text"])
        hand_back()


def sanitise(text: str, spans) -> str:
    """The text with spans generalised to their kind; of overlapping spans the earliest decides."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], MASKS[kind]]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({f"{kind}:{text[a:b].lower()}" for a, b, kind in base_spans(text)}) for text in (value.as_py() for value in batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.string()))], ["row", "entities"])


def _with_terms(docs: DataFrame, alpha: float, support: int, name: str) -> DataFrame:
    """The input's rows with the terms that disclose an entity they hold, as column ``name`` (null: none)."""
    terms = disclosing_terms(docs, alpha, support)
    known, size = terms.agg(F.count("*"), F.sum(F.size("terms") * 24 + 48)).first()
    if not known:
        return docs.withColumn(name, F.lit(None).cast("array<string>"))
    # equal texts share their terms, so the text's hash is key enough
    text, key = F.coalesce("text", F.lit("")), free_name(docs, name + "_row")
    held = docs.where(text.rlike("[@+0-9]")).select(F.xxhash64(text).alias("row"), text.alias("text"))
    held = held.mapInArrow(_entities, "row long, entities array<string>").select("row", F.explode("entities").alias("entity")).distinct()
    per_text = held.join(maybe_broadcast(terms, known, size / known), "entity").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias(name))
    per_text = materialise(per_text, "text-terms").withColumnRenamed("row", key)
    remove(docs.sparkSession, table_path(terms))
    rows, size = per_text.agg(F.count("*"), F.sum(F.size(name) * 24 + 32)).first()
    return docs.withColumn(key, F.xxhash64(text)).join(maybe_broadcast(per_text, rows, size / max(rows, 1) if size else 32), key, "left").drop(key)


def find_personal_data(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and clean_text of every document."""
    rows = _with_terms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), alpha, support, "terms")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "terms")
    return rows.mapInArrow(_marked, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean_text string")


def sanitise_documents(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """The input's rows and columns with spans generalised in text, and n_chars following it. Null texts stay null."""
    held = free_name(docs, "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = ((text.as_py(), terms.as_py()) for text, terms in zip(batch.column("text"), batch.column(held)))
            texts = [None if t is None else sanitise(t, all_spans(t, terms)[1]) for t, terms in pairs]
            columns = {name: batch.column(name) for name in batch.schema.names if name != held}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                n = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
                columns["n_chars"] = n.fill_null(0) if n.null_count and not columns["n_chars"].null_count else n
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            hand_back()

    return _with_terms(docs, alpha, support, held).mapInArrow(run, docs.schema)
