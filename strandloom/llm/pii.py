"""Personal information inside free text: found, typed, and replaced by placeholders.

Method: information-theoretic sanitisation. One pass over each text takes candidates,
wide on purpose: numbers, names in capitals, places with numbers. Which of them are
protected entities is decided by what corpus co-occurrence says about their terms: the
digit shape of a number and the word in front of it, a given name, a street word, the
words before and after. For a term t and an entity kind c the corpus gives the pointwise
mutual information PMI(c; t) = log2 P(c | t) / P(c), and of the information content
IC(c) = -log2 P(c) there remains, for a reader who knows t, the surprisal

    IC(c) - PMI(c; t) = -log2 P(c | t)   bits.

The fewer bits remain, the more t discloses. At or below REMOVE bits the candidate is an
entity and a typed placeholder takes its place; between that and GENERALISE bits more it is
no entity, but `redacted` leaves a more general form of it: digits become #, a given name
its initial, a house number goes.

Occurrences that need no corpus start the estimate: a number with an international prefix
or after a word for telephone or identity, an author field, an address with a postcode.
From there P(c | t) is learnt in turns: shapes from the words in front of them, words from
the shapes behind them, so labels, shapes and lengths come from the corpus.

  numbers   a disclosing shape, or a disclosing word before a shape that is not known as harmless
  address   a disclosing street word, or number and postcode together
  person    1. given names disclose by their occurrences in author fields
            2. words around names found in step 1 disclose names with initials only
  email     its form says enough

The counts are kept as tables and joined, salted, so neither the corpus nor a term that
most candidates have need fit anywhere. Names inside bibliographies are no candidates;
comments are read as text.

Null and empty texts have no candidates. Overlapping names: the one that starts
first wins. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize

#: Most bits that may remain for an entity to be removed, by what discloses it.
REMOVE = {"shape": math.log2(5), "label": math.log2(5), "street": math.log2(5), "given": math.log2(10), "cue": 1.0}
#: Bits beyond that up to which a candidate is generalised.
GENERALISE = 1.5
#: A shape with separators or letters that is seen this often, hardly ever as an entity, is harmless whatever stands before it.
HARMLESS = 20
#: Salts of the joins with what the corpus says about a term.
SALTS = 16

# Words for telephone and identity, from which the corpus's labels are learnt.
PHONE_SEEDS = ("tel", "telephone", "phone", "fax", "telefon", "telefax", "teléfono", "téléphone", "mobile", "mobil")
ID_SEEDS = ("id", "ssn", "passport", "identity", "identidad", "identité", "d'identité", "ausweis", "ausweisnummer", "personalausweis", "dni", "nif")
PARTICLES = "[Vv]an|VAN|[Vv]on|VON|[Dd]e|DE|der|DER|den|del|della|di|da|la|le|ter|zu"

_LETTERS = r"(?:[^\s,.;:{}()<>~\\%$&|\[\]\"!?/\d=+*@#_^]|\\[\"'`^~=.][A-Za-z])"


def _class(of: Callable[[str], bool]) -> str:
    """The letters below U+2000 that `of` holds for, as ranges of a character class."""
    at = [i for i in range(0x41, 0x2000) if of(chr(i))]
    heads = [i for i, before in zip(at, [0, *at]) if i != before + 1]
    tails = [i for i, after in zip(at, [*at[1:], 0]) if after != i + 1]
    return "".join(chr(x) if x == y else f"{chr(x)}-{chr(y)}" for x, y in zip(heads, tails, strict=True))


_UP, _LOW = _class(str.isupper), _class(str.islower)
_FAMILY = rf"[{_UP}]{_LETTERS}+"
_GIVEN = rf"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?"
_NAME = rf"(?P<g>{_GIVEN}|[{_UP}]\.)(?:[\s~]*[\s~][{_UP}]\.)*[\s~]*(?<=[\s~.])(?:(?:{PARTICLES})[\s~]+){{0,2}}(?P<f>{_FAMILY})"
_TURNED = rf"(?:\b(?:{PARTICLES})[\s~]+)?(?P<f>{_FAMILY}),[\s~]+(?P<g>{_GIVEN})(?:[\s~]+[{_UP}]\.)?"
NAME = re.compile(_NAME)
TURNED = re.compile(_TURNED)
#: Where a name may begin: a given name or initial with a capital word close behind.
NAME_AT = re.compile(rf"(?<![\w\\\"'.-])(?=[{_UP}](?:[{_LOW}-]+[\s~]|\.)[\s~]*(?:[{_UP}]\.[\s~]*)*(?:(?:{PARTICLES})[\s~]+){{0,2}}[{_UP}]\S)")
TURNED_AT = re.compile(rf"(?<![\w\\\"'.-])(?:(?:{PARTICLES})[\s~]+)?{_FAMILY},[\s~]+(?=[{_UP}][{_LOW}])")
AUTHOR = re.compile(r"\\author(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
AND = re.compile(r"\\and\b")
BIB = re.compile(r"\\begin\{thebibliography\}[\s\S]*?(?:\\end\{thebibliography\}|\Z)|\\bibitem[^\n]*(?:\n(?!\s*\n)[^\n]*)*")

_LABEL = r"[A-Za-z0-9-]+"
EMAIL = re.compile(
    r"(?:\\?\{[\w.+\-]+(?:\s*[,|;]\s*[\w.+\-]+)+\\?\}|(?<![\w.+\-\\{])[A-Za-z0-9](?:[\w.+\-]|\\_)*|(?<=\{)[A-Za-z0-9](?:[\w.+\-]|\\_)*)"
    rf"(?:@(?:{_LABEL}\.)+[A-Za-z]{{2,}}"
    rf"|\s*[(\[]\s*at\s*[)\]]\s*{_LABEL}(?:(?:\s*[(\[]\s*dot\s*[)\]]\s*|\.){_LABEL})*(?:\s*[(\[]\s*dot\s*[)\]]\s*|\.)[A-Za-z]{{2,}}"
    rf"|\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})*\s+dot\s+[A-Za-z]{{2,}})(?![\w])",
    re.IGNORECASE,
)
EMAIL_HINT = re.compile(r"@|[(\[]\s*at\s*[)\]]|\sat\s+[A-Za-z0-9-]+\s+dot\s", re.IGNORECASE)
_GAP = r"[\s~]{1,3}"
NUMBER = re.compile(
    rf"(?<![\w.,/^_+\-])(?:[A-Z]{{2}}-(?:\d+-)*\d+|[A-Z]{{2}}\d{{2}}(?:{_GAP}\d{{4}}){{2,7}}(?:{_GAP}\d{{1,3}})?|[A-Z]{{1,3}}\d{{6,9}}"
    rf"|\d{{2}}(?:{_GAP}\d{{3}}){{2}}{_GAP}[A-Z]"
    rf"|\+\d{{1,3}}(?:(?:{_GAP}|[.\-/])\d{{1,6}}|[\s~]*\(\d{{1,5}}\)[\s~]*\d{{1,6}}){{1,6}}|\(\d{{1,5}}\)[\s~]*\d{{2,5}}(?:(?:{_GAP}|[.-])\d{{2,6}})*"
    rf"|\d{{1,6}}(?:(?:{_GAP}|[.\-/])\d{{1,6}}){{1,7}}|\d{{5,}})(?!\w|[\-/.~]\d)"
)
_PLACE = rf"[{_UP}][^\s,.;:\d{{}}()<>\\]+"
_TOWN = rf"{_PLACE}"
ADDRESS = re.compile(
    rf"(?P<box>\bP\.?\s?O\.?\s+Box\s+\d+,\s+(?:\d{{5}}\s+)?{_TOWN}(?:\s+\d{{5}}\b)?)"
    rf"|(?P<en>(?:\b[A-Z][a-z]+\.?\s+\d+,\s+)?\b\d{{1,4}}\s+{_PLACE}\s+(?P<type>{_PLACE}\.?),\s+{_TOWN}(?:\s+\d{{5}}\b)?)"
    rf"|(?P<fr>\b\d{{1,4}},?\s+(?P<voie>[a-z]+)\s+{_PLACE},\s+\d{{5}}\s+{_TOWN})"
    rf"|(?P<de>(?:\b{_PLACE}\s+)?(?<![\w\\]){_PLACE}\s+\d{{1,4}},\s+\d{{5}}\s+{_TOWN})"
)
ADDRESS_HINT = re.compile(r"\d,?\s+\S+\s+[^\s,]+,\s+(?:\d{5}\s+)?[^\W\d_]|\d,\s+(?:\d{5}\s+)?[^\W\d_]")
_SPACE = re.compile(r"\s+")
_BESIDE = re.compile(r"[^\W\d_][^\w\d]{0,8}$")
_WORDS = re.compile(r"[^\W\d_](?:[^\W\d_]|['’])*")

SCHEMA = "doc bigint, kind string, value string, start int, stop int, term string, left1 string, left2 string, right2 string, given_away boolean"


def _shape(value: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", _SPACE.sub(" ", value.replace("~", " "))))


def _before(text: str, at: int) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text[max(0, at - 40) : at])][-2:]


def _after(text: str, at: int) -> str:
    return " ".join(w.lower() for w in _WORDS.findall(text[at : at + 24])[:2])


def _inside(spans: list[tuple[int, int]], at: int) -> bool:
    return any(a <= at < b for a, b in spans)


def candidates(text: str) -> list[tuple]:
    """(kind, value, start, stop, term, left1, left2, right2, given_away)."""
    out = []

    def add(kind, start, stop, term, given_away=False):
        left = _before(text, start)
        out.append((
            kind, _SPACE.sub(" ", text[start:stop]), start, stop, term, left[-1] if left else "", " ".join(left), _after(text, stop), given_away,
        ))

    if EMAIL_HINT.search(text):
        for m in EMAIL.finditer(text):
            add("email", m.start(), m.end(), "", True)
    for m in NUMBER.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        left = _before(text, m.start())
        label = left[-1] if left and _BESIDE.search(text[max(0, m.start() - 12) : m.start()]) else ""
        # a short or ungrouped number is a candidate only by the word in front of it
        if digits >= 7 and not m.group().isdigit() or digits >= 5 and label:
            kind = "phone" if m.group()[0] == "+" or label in PHONE_SEEDS else "id_number" if label in ID_SEEDS else ""
            out.append(("number", _SPACE.sub(" ", m.group()), m.start(), m.end(), _shape(m.group()), label, kind, "", label in PHONE_SEEDS or label in ID_SEEDS))
    if ADDRESS_HINT.search(text):
        for m in ADDRESS.finditer(text):
            word = m.group("type") or ""
            add("address", m.start(), m.end(), word, not word or bool(re.search(r"\d{5}$", m.group())))
    bib = [m.span() for m in BIB.finditer(text)] if "\\bibitem" in text or "{thebibliography}" in text else []
    fields = []
    for m in AUTHOR.finditer(text):
        fields.append(m.span())
        at = m.start(1)
        for part in AND.split(m.group(1)):
            name = part.strip()
            start = text.index(name, at) if name else at
            got = NAME.fullmatch(name) or TURNED.fullmatch(name)
            if got:
                add("person", start, start + len(name), "" if got["g"].endswith(".") else got["g"], True)
            at += len(part) + 4
    for m in NAME_AT.finditer(text):
        got = NAME.match(text, m.start())
        if got and not _inside(bib, m.start()) and not _inside(fields, m.start()):
            stop = got.end() - (len(got.group()) - len(got.group().rstrip("-'’")))
            add("person", m.start(), stop, "" if got["g"].endswith(".") else got["g"])
    for m in TURNED_AT.finditer(text):
        got = TURNED.match(text, m.start())
        if got and not _inside(bib, m.start()) and not _inside(fields, m.start()):
            add("person", m.start(), got.end(), got["g"])
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.bool_()]
    names = ["doc", "kind", "value", "start", "stop", "term", "left1", "left2", "right2", "given_away"]
    for batch in batches:
        docs, rows = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                found = candidates(text)
                docs += [doc] * len(found)
                rows += found
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)


def remaining(of: Column) -> Column:
    """Bits that remain of an entity for who knows the term: -log2 P(entity | term), all of them (null) without a case.

    One more occurrence without, half counted, keeps rare terms from disclosing."""
    return -F.log2(F.sum(of.cast("bigint")) / (F.count(F.lit(1)) + 0.5))


def _told(rows: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Left join of candidates with what the corpus says about a term; rows are spread over salts, those without a term over many."""
    salt = F.pmod(F.xxhash64("doc", "start"), F.when(F.col(key) == "", 1 << 16).otherwise(SALTS)).cast("int")
    spread = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(spread, [key, "salt"], "left").drop("salt")


_KINDS = ("phone", "id_number")
_OUT = ("doc", "kind", "value", "start", "stop", "term", "bits")


def _numbers(found: DataFrame) -> DataFrame:
    rows = found.filter("kind = 'number'").select("doc", "value", "start", "stop", F.col("term").alias("shape"), F.col("left1").alias("label"), F.col("left2").alias("seed"), "given_away")
    # shapes learn from seeds, labels from seeds and shapes, shapes again from labels
    shapes = rows.groupBy("shape").agg(*(remaining(F.col("seed") == k).alias(f"s_{k}") for k in _KINDS))
    known = lambda c, k, most: F.coalesce(F.col(f"{c}_{k}") <= most, F.lit(False))
    first = _told(rows, shapes, "shape")
    labels = first.filter("label <> ''").groupBy("label").agg(*(remaining((F.col("seed") == k) | known("s", k, REMOVE["shape"])).alias(f"l_{k}") for k in _KINDS))
    labels = labels.filter(F.least(*(f"l_{k}" for k in _KINDS)) <= REMOVE["label"] + GENERALISE)
    second = _told(rows, labels, "label")
    again = second.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), *(remaining((F.col("seed") == k) | known("l", k, REMOVE["label"])).alias(f"s_{k}") for k in _KINDS))
    judged = _told(second, again, "shape")
    every = F.lit(64.0)
    bits = {}
    for k in _KINDS:
        shape, label = F.coalesce(f"s_{k}", every), F.coalesce(f"l_{k}", every)
        # digits alone are no shape to go by
        harmless = (F.col("n") >= HARMLESS) & (shape > REMOVE["shape"] + GENERALISE) & F.col("shape").rlike("[^9]")
        # a seed in front says it outright
        sure = (F.col("seed") == k) & (F.col("given_away") | (k == "phone"))
        bits[k] = F.when(sure, 0.0).otherwise(F.least(shape, F.when(harmless, every).otherwise(label)))
    kind = F.when(F.col("seed") != "", F.col("seed")).when(bits["phone"] <= bits["id_number"], "phone").otherwise("id_number")
    return judged.select("doc", kind.alias("kind"), "value", "start", "stop", F.lit("").alias("term"), (F.least(*bits.values()) - REMOVE["shape"]).alias("bits"))


def _addresses(found: DataFrame) -> DataFrame:
    rows = found.filter("kind = 'address'")
    words = rows.filter("term <> ''").groupBy("term").agg(remaining(F.col("given_away")).alias("b")).filter(F.col("b") <= REMOVE["street"] + GENERALISE)
    bits = F.when(F.col("given_away"), 0.0).otherwise(F.coalesce("b", F.lit(64.0)))
    return _told(rows, words, "term").select("doc", "kind", "value", "start", "stop", F.lit("").alias("term"), (bits - REMOVE["street"]).alias("bits"))


def _persons(found: DataFrame) -> DataFrame:
    rows = found.filter("kind = 'person'")
    given = rows.filter("term <> ''").groupBy("term").agg(remaining(F.col("given_away")).alias("g")).filter(F.col("g") <= REMOVE["given"] + GENERALISE)
    bits = F.when(F.col("given_away"), 0.0).otherwise(F.coalesce("g", F.lit(64.0))) - REMOVE["given"]
    rows = _told(rows, given, "term").withColumn("bits", bits).withColumn("known", F.col("bits") <= 0)
    inline = rows.filter(~F.col("given_away"))
    for c in ("left2", "right2"):
        cue = inline.filter(F.col(c) != "").groupBy(c).agg(remaining(F.col("known")).alias(f"by_{c}")).filter(F.col(f"by_{c}") <= REMOVE["cue"] + GENERALISE)
        rows = _told(rows, cue, c)
    by_cue = F.when(F.col("term") == "", F.least(F.coalesce("by_left2", F.lit(64.0)), F.coalesce("by_right2", F.lit(64.0))) - REMOVE["cue"])
    kept = rows.withColumn("bits", F.least("bits", F.coalesce(by_cue, "bits"))).filter(F.col("bits") <= GENERALISE)
    # of overlapping names the one that starts first stays; an entity before a doubtful one
    over = W.partitionBy("doc", F.col("bits") <= 0).orderBy("start", F.desc("stop")).rowsBetween(W.unboundedPreceding, -1)
    kept = kept.withColumn("reach", F.max("stop").over(over)).filter("reach is null or reach <= start")
    return kept.select(*_OUT)


def judged(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, kind, value, start, stop, term and bits: how far the remaining bits lie above what is removed, up to GENERALISE."""
    rows = documents.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    found, _ = materialize(rows.mapInArrow(_extract, SCHEMA), "candidates")
    mails = found.filter("kind = 'email'").select("doc", "kind", "value", "start", "stop", "term", F.lit(-1.0).alias("bits"))
    every = mails.unionByName(_numbers(found)).unionByName(_addresses(found)).unionByName(_persons(found))
    return every.filter(F.col("bits") <= GENERALISE)


def entities(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, kind, value (white space as single blanks), start, stop (in characters)."""
    return judged(documents, doc, text).filter("bits <= 0").select("doc", "kind", "value", "start", "stop")


def general(kind: str, value: str, given: str) -> str:
    """The more general form of a doubtful candidate."""
    if kind == "person":
        return value.replace(given, given[0] + ".", 1) if given else value
    if kind == "address":
        return re.sub(r"\d+", "", value).strip(" ,")
    return re.sub(r"\d", "#", value)


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text is None or not spans:
                out.append(text)
                continue
            # entities first, then what is only generalised, where nothing lies yet
            chosen: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["bits"] > 0, s["start"])):
                if all(s["stop"] <= c["start"] or s["start"] >= c["stop"] for c in chosen):
                    chosen.append(s)
            parts, at = [], 0
            for s in sorted(chosen, key=lambda s: s["start"]):
                held = text[s["start"] : s["stop"]]
                parts += [text[at : s["start"]], f"[{s['kind'].upper()}]" if s["bits"] <= 0 else general(s["kind"], held, s["term"])]
                at = s["stop"]
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc", "text"])


def redacted(documents: DataFrame, doc: str, text: str, found: DataFrame) -> DataFrame:
    """doc, text with every entity of `found` (see `judged`) replaced by its kind in brackets and doubtful candidates by a more
    general form; rows without either are kept as they are."""
    spans = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "term", "bits"))).alias("spans"))
    rows = documents.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return rows.join(spans, "doc", "left").mapInArrow(_replace, "doc bigint, text string")
