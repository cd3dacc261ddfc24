"""Normalisation of model output and small text functions, as Catalyst expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of text that a model may name.
TEXT_KINDS = ["document", "handwriting", "sign", "screenshot", "label", "meme", "other", "none"]
RESULT = "has_text variant, text variant, context string, text_kind string, language string, category string"
MATCHES = "matches array<struct<person_id:string,present:variant,confidence:string>>"


def category(value: Column) -> Column:
    """Lower case, white space collapsed, 40 characters at most; ``other`` if nothing is left."""
    flat = F.trim(F.substring(F.trim(F.regexp_replace(F.lower(value), r"\s+", " ")), 1, 40))
    return F.when(F.coalesce(flat, F.lit("")) == "", "other").otherwise(flat)


def collapse(value: Column, most: int | None = None) -> Column:
    flat = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.substring(flat, 1, most) if most else flat


def snippet(value: Column, limit: int = 220) -> Column:
    """White space flattened; a longer text is cut at its last space before the limit and marked."""
    flat = collapse(value)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit), " [^ ]*$", ""), F.lit(" ...")))


def basename(path: Column) -> Column:
    return F.coalesce(F.substring_index(path, "/", -1), F.lit("(no location)"))


def truthy(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(value)).isin("", "0", "false", "no"), F.lit(False))


def parse_box(value: Column) -> Column:
    """``x,y,w,h`` as a struct; null for blank or wrong boxes (corner below 0, side not above 0)."""
    part = F.split(value, ",")
    number = [F.trim(part[i]).try_cast("int") for i in range(4)]
    box = F.struct(*[n.alias(c) for n, c in zip(number, "xywh", strict=True)])
    good = (F.size(part) == 4) & (number[0] >= 0) & (number[1] >= 0) & (number[2] > 0) & (number[3] > 0)
    return F.when(good, box)


def parse_duration(value: Column) -> Column:
    """Seconds of ``45``, ``90m``, ``1h30m``, ``2d``; null for anything else, or nothing above zero."""
    text = F.lower(F.trim(value))
    scale = {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0}
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?[dhms]?)"), 1)

    def seconds(x: Column) -> Column:
        unit = F.regexp_extract(x, "[dhms]$", 0)
        factor = F.lit(1.0)
        for name, size in scale.items():
            factor = F.when(unit == name, size).otherwise(factor)
        return F.regexp_extract(x, r"^[\d.]+", 0).try_cast("double") * factor

    total = F.aggregate(F.transform(parts, seconds), F.lit(0.0), lambda a, b: a + b)
    return F.when(text.rlike(r"^(\d+(\.\d+)?[dhms]?)+$") & (total > 0), total)


def norm_path(path: Column, home: str = "") -> Column:
    """A path for comparison: ``~`` becomes the home folder, ``.`` and doubled or trailing slashes go, in lower case; links are not followed."""
    whole = F.when(path.startswith("~/"), F.concat(F.lit(home), F.substring(path, 2, 2**30))).otherwise(path)
    flat = F.regexp_replace(F.regexp_replace(whole, r"/(\./)+", "/"), r"/{2,}", "/")
    return F.lower(F.when(F.length(flat) > 1, F.regexp_replace(flat, r"/$", "")).otherwise(flat))


def person_name(name: Column) -> Column:
    """White space collapsed; null unless 1 to 60 characters are left."""
    flat = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when(F.length(flat).between(1, 60), flat)


def clean_text(raw_bytes: Column) -> Column:
    """Bytes as text; what is no valid UTF-8, lone surrogates among them, becomes U+FFFD."""
    return F.make_valid_utf8(raw_bytes.cast("string"))


def recognised_text(lines: Column) -> Column:
    """Lines that a recogniser found as one text, blank ones left out; null if nothing is left."""
    text = F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n")
    return F.when(text != "", text)


def model_name(name: Column) -> Column:
    return F.regexp_replace(name, ":latest$", "")


def size_text(n: Column) -> Column:
    """Bytes with one decimal, half to even, in the largest unit that leaves at least 1."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n / 1024**power, 1))).otherwise(out)
    return out


def embedding_text(text: Column, context: Column) -> Column:
    """What is embedded: text and context by a line feed; null if both are blank."""
    both = F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.coalesce(context, F.lit("")))
    return F.when(strip(both) != "", both)


def json_text(content: Column) -> Column:
    """The JSON object in a model's answer: all of it, or from the first ``{`` to the last ``}``; null if neither parses."""

    def whole(x: Column) -> Column:
        return F.when(F.trim(x).startswith("{") & F.trim(x).endswith("}") & F.try_parse_json(x).isNotNull(), F.trim(x))

    first, last = F.instr(content, "{"), F.length(content) - F.instr(F.reverse(content), "}") + 1
    inner = F.when((first > 0) & (last > first), F.substring(content, first, last - first + 1))
    return F.coalesce(whole(content), whole(inner))


def _truth(v: Column) -> Column:
    """Whether a JSON value counts as true: a boolean as it says, a string or a list unless empty, a number unless 0; null is false."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    by_kind = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind.isin("STRING", "VOID"), text != "").when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(v).isin("[]", "{}"))
    return F.coalesce(by_kind.otherwise(F.try_variant_get(v, "$", "double") != 0), F.lit(False))


def _few_lines(text: Column) -> Column:
    """Runs of three or more line feeds become two; none at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def result(content: Column) -> Column:
    """A normalised extraction result: struct of has_text, text, context, text_kind, language, category.

    ``has_text`` counts only as a boolean; else it says whether the stated text is empty. An answer without an object has no text.
    """
    raw = F.from_json(json_text(content), RESULT)
    said = F.try_variant_get(raw["text"], "$", "string")
    kind = F.lower(F.trim(F.coalesce(raw["text_kind"], F.lit(""))))
    language = F.trim(F.coalesce(raw["language"], F.lit("")))
    stated = F.when(F.schema_of_variant(raw["has_text"]) == "BOOLEAN", F.try_variant_get(raw["has_text"], "$", "boolean"))
    return F.struct(
        F.coalesce(stated, _truth(raw["text"])).alias("has_text"),
        F.coalesce(_few_lines(said), F.lit("")).alias("text"),
        F.coalesce(raw["context"], F.lit("")).alias("context"),
        F.when(kind.isin(*TEXT_KINDS), kind).when(kind == "", "none").otherwise("other").alias("text_kind"),
        F.when(language == "", "unknown").otherwise(language).alias("language"),
        category(raw["category"]).alias("category"),
    )


def gate_result(content: Column) -> Column:
    """A gate's answer: never text, only context, its line feeds collapsed, and category."""
    raw = F.from_json(json_text(content), RESULT)
    return F.struct(F.lit(False).alias("has_text"), F.lit("").alias("text"), F.coalesce(_few_lines(raw["context"]), F.lit("")).alias("context"), F.lit("none").alias("text_kind"), F.lit("unknown").alias("language"), category(raw["category"]).alias("category"))


def person_matches(content: Column, valid: Column) -> Column:
    """Matches of known people: first of each id wins; confidence 1 or 0 by presence if absent, kept within 0 and 1."""
    raw = F.from_json(json_text(content), MATCHES)["matches"]

    def one(m: Column) -> Column:
        kind = F.schema_of_variant(m["present"])  # a string is true unless empty, even "false"
        stated = F.when(kind == "BOOLEAN", F.try_variant_get(m["present"], "$", "boolean")).when(kind == "STRING", F.try_variant_get(m["present"], "$", "string") != "").otherwise(F.try_variant_get(m["present"], "$", "double") != 0)
        present = F.coalesce(stated, F.lit(False))
        sure = F.coalesce(m["confidence"].try_cast("double"), F.when(present, 1.0).otherwise(0.0))
        return F.struct(m["person_id"].try_cast("long").alias("person_id"), present.alias("present"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"))

    known = F.filter(F.transform(raw, one), lambda m: m["person_id"].isNotNull() & F.array_contains(valid, m["person_id"]))
    ids = F.transform(known, lambda m: m["person_id"])
    return F.filter(known, lambda m, i: F.array_position(ids, m["person_id"]) == i + 1)


def strip(value: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def merge_tiles(tiles: Column) -> Column:
    """One result from those of tiles, in order: stripped texts by blank lines, all contexts by bars, the rest from the first with text.

    Without text there is no category.
    """
    full = F.filter(tiles, lambda t: t["has_text"] & (strip(t["text"]) != ""))
    first = F.get(full, F.lit(0))
    contexts = F.filter(F.transform(tiles, lambda t: t["context"]), lambda c: strip(c) != "")
    return F.struct(
        (F.size(full) > 0).alias("has_text"),
        F.array_join(F.transform(full, lambda t: strip(t["text"])), "\n\n").alias("text"),
        F.array_join(contexts, " | ").alias("context"),
        F.coalesce(first["text_kind"], F.lit("none")).alias("text_kind"),
        F.coalesce(first["language"], F.lit("unknown")).alias("language"),
        F.when(F.size(full) > 0, F.when(first["category"] == "", "other").otherwise(F.coalesce(first["category"], F.lit("other")))).alias("category"),
    )


#: Marks that belong to the word they stand in and are left out of it, as ranges; other marks part words.
JOINING_MARKS = "0300-0304 0306-030C 030F 0311 031B 0323-0328 032D-032E 0330-0331"


def _folded(c: str) -> str:
    """A letter without case, and without the mark if it is an ASCII letter with just one."""
    low = c.casefold() if len(c.casefold()) == 1 else c.lower()[0]
    parts = unicodedata.normalize("NFD", low)
    return parts[0] if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.category(parts[1]) == "Mn" else low


def _folds() -> dict[str, str]:
    """All characters of the basic plane that folding changes, with what they become; marks that join words become nothing."""
    letters = (c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] in "LN")
    marks = (r.split("-") for r in JOINING_MARKS.split())
    return {c: f for c in letters if (f := _folded(c)) != c} | {chr(i): "" for r in marks for i in range(int(r[0], 16), int(r[-1], 16) + 1)}


FOLDS = _folds()
_FROM = "".join(sorted(FOLDS, key=lambda c: FOLDS[c] == ""))  # what becomes nothing stands last
_TO = "".join(FOLDS[c] for c in _FROM)
_KINDS = r"\p{L}\p{N}\p{Co}\p{Cn}"
_WORD = rf"([{_KINDS}]+)"
_MARKS = "".join("-".join(rf"\x{{{end}}}" for end in r.split("-")) for r in JOINING_MARKS.split())
_SPELLED = rf"([^{_KINDS}]*)([{_KINDS}][{_KINDS}{_MARKS}]*)"


def fold(text: str) -> str:
    """A text as ``tokens`` folds it."""
    return text.translate({ord(c): f for c, f in FOLDS.items()})


def tokens(value: Column) -> Column:
    """Runs of letters, numbers and characters of no known kind, case and diacritics folded; a null text has none.

    Marks in words join them and are left out; a letter with several marks keeps them. These are the words of a
    full-text index with a Unicode tokenizer; it knows no letter that came to have a case after its time.
    """
    return F.regexp_extract_all(F.translate(F.coalesce(value, F.lit("")), _FROM, _TO), F.lit(_WORD), 1)


def spelled(value: Column) -> tuple[Column, Column]:
    """What stands before each word of ``tokens``, and the word, as they are in the text."""
    rest = F.coalesce(value, F.lit(""))
    return F.regexp_extract_all(rest, F.lit(_SPELLED), 1), F.regexp_extract_all(rest, F.lit(_SPELLED), 2)


def photo_hash(bright: Column) -> Column:
    """63 bits: bit k says whether value k is above value k + 1. Written out bit by bit, so that it is compiled."""
    bits = [F.when(F.get(bright, F.lit(k)) > F.get(bright, F.lit(k + 1)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(63)]
    while len(bits) > 1:
        bits = [bits[i].bitwiseOR(bits[i + 1]) if i + 1 < len(bits) else bits[i] for i in range(0, len(bits), 2)]
    return bits[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common prefix as doubles; null if either norm is zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, F.lit(1), n), lambda c: c.cast("double")) for v in (a, b))

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda acc, c: acc + c)

    norms = F.sqrt(total(F.transform(x, lambda c: c * c))) * F.sqrt(total(F.transform(y, lambda c: c * c)))
    return F.when(norms > 0, total(F.zip_with(x, y, lambda c, d: c * d)) / norms)
