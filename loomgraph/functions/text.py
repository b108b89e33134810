"""Text functions as Column expressions; Arrow functions only where no built-in says it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Stop words left out of content tokens.
STOPWORDS = (
    "a an the and or but if then else when at from by for with about against between into through during before "
    "after above below to of up down in out on off over under again further once here there where why how all any "
    "both each few more most other some such no nor not only own same so than too very can will just should now is "
    "are was were be been being have has had having do does did doing would could role play"
).split()
#: Signs of text that tries to give orders.
INJECTION_PATTERNS = (
    r"(?i)ignore\s+(?:all\s+)?previous\s+instructions",
    r"(?i)system\s+prompt\s*:",
    r"(?i)<script[\s>]",
    r"(?i)rm\s+-rf\s+[/~]",
    r"(?i)exec\s*\(\s*['\"]",
    r"(?i)os\.system\s*\(",
    r"(?i)shutil\.rmtree\s*\(",
)
WINDOW, OVERLAP = 500, 50


def _structs(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII word characters that no other letter or digit touches."""
    # The character before is consumed, not looked back at: that sees half a pair where a letter takes two units.
    alone = F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}\p{N}_\x{DC00}-\x{DFFF}])([A-Za-z0-9_]++)(?![\p{L}\p{N}])"), F.lit(1))
    return F.transform(alone, lambda x: F.lower(x))


def tokenize_with_ids(text: Column) -> Column:
    """Tokens that keep hyphens, so that identifiers stay whole."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_][A-Za-z0-9_-]*)"), F.lit(1)), lambda x: F.lower(x))


def content_tokens(text: Column) -> Column:
    """Different tokens without stop words."""
    return F.array_except(F.array_distinct(tokenize(text)), F.array(*map(F.lit, STOPWORDS)))


def entailment(claim: Column, passage: Column) -> Column:
    """Share of the claim's content tokens that the passage has; 0 for a claim without any."""
    wanted = content_tokens(claim)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, F.array_distinct(tokenize(passage)))) / F.size(wanted)).otherwise(0.0)


def chunk_windows(text: Column, width: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of characters; the last one ends with the text."""
    step = width - overlap
    last = F.greatest(F.ceil((F.length(text) - width) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * step + 1, F.lit(width)))


def normalize_plain(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form, which has no built-in."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def ascii_slug(text: pd.Series) -> pd.Series:
    """Letters and digits of the decomposed text in lower case, joined by hyphens."""

    def one(t):
        if t is None:
            return None
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-")

    return text.map(one)


def normalize_chunk_text(text: Column) -> Column:
    return normalize_plain(nfkc(text))


def strip_frontmatter(text: Column) -> Column:
    """What follows the second '---'; the text itself where there are fewer."""
    parts = F.split(text, "---", 3)
    return F.trim(F.when(F.size(parts) >= 3, F.get(parts, 2)).otherwise(text))


def body_excerpt(text: Column, most: int = 250) -> Column:
    """First line that is neither blank nor a heading, cut at most characters."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    first = F.coalesce(F.get(lines, 0), F.lit(""))
    return F.when(F.length(first) > most, F.concat(F.rtrim(F.substring(first, 1, most)), F.lit("..."))).otherwise(first)


def links(text: Column) -> Column:
    """Targets of inline links, reference links and wiki links, each once."""
    inline = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    reference = F.regexp_extract_all(text, F.lit(r"(?m)^\[[^\]]+\]:\s*(\S+)"), F.lit(1))
    wiki = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))
    return F.array_distinct(F.concat(inline, reference, F.transform(wiki, lambda x: F.trim(x))))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"href=\"([^\"]*)\""), F.lit(1))


def injection_indicators(text: Column) -> Column:
    """First match of each pattern that occurs."""
    return F.filter(F.array(*[F.regexp_extract(text, p, 0) for p in INJECTION_PATTERNS]), lambda x: x != "")


def fence(text: Column) -> Column:
    """Text between markers, with anything that looks like a marker made harmless."""
    safe = F.regexp_replace(text, r"(?i)<(\s*/?\s*untrusted_source\s*/?\s*)>", "&lt;$1&gt;")
    return F.concat(F.lit("<untrusted_source>\n"), safe, F.lit("\n</untrusted_source>"))


def citation_ids(text: Column) -> Column:
    """Numbers cited in brackets, alone or several, with or without a prefix."""
    blocks = F.regexp_extract_all(text, F.lit(r"\[((?:PMID:\s*)?\d+(?:\s*,\s*(?:PMID:\s*)?\d+)*)\]"), F.lit(1))
    return F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(\d+)"), F.lit(1))))


def passage_budget(text: Column, tokens: int = 512, chars_per_token: int = 4) -> Column:
    most = tokens * chars_per_token
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("\n\n[...]"))).otherwise(text)


def scoring_window(text: Column, tokens: int = 512, chars_per_token: int = 4) -> Column:
    """A long text's opening with its conclusion, or with its end where no conclusion is marked."""
    most = tokens * chars_per_token
    half = most // 2
    at = F.regexp_instr(text, F.lit(r"(?i)##+\s*(?:conclusions?|findings?|discussion|summary)"))
    at = F.when(at > 0, at).otherwise(F.regexp_instr(text, F.lit(r"(?i)\n(?:conclusions?|findings?):")))
    ending = F.substr(text, at, F.lit(half))
    marked = F.concat(F.rtrim(F.substr(text, F.lit(1), F.lit(most - 10) - F.length(ending))), F.lit("\n\n[...]\n\n"), F.ltrim(ending))
    plain = F.concat(F.rtrim(F.substring(text, 1, half)), F.lit("\n\n[...]\n\n"), F.ltrim(F.substring(text, -half, half)))
    return F.when(F.length(text) <= most, text).when(at > 0, marked).otherwise(plain)


def sha256_id(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def source_ref(ref: Column) -> Column:
    return normalize_plain(ref)


def source_refs(refs: Column) -> Column:
    """The different references of a list in their plain form; blank and null ones don't count."""
    plain = F.transform(F.coalesce(refs, F.array().cast("array<string>")), source_ref)
    return F.array_distinct(F.filter(plain, lambda x: x.isNotNull() & (x != "")))


def context_tokens(nodes: Column, paths: Column) -> Column:
    return F.lit(50) + nodes * 15 + paths * 20


def trust_tier(verification: Column) -> Column:
    """What a bundle says of how an object was verified."""
    return F.when(verification.isin("formal_proof", "peer_verified"), "human-reviewed").when(verification == "self_verified", "machine-confirmed").otherwise("unverified")


def bundle_status(status: Column) -> Column:
    """The three states of a bundle; what isn't known is stable."""
    return F.when(status == "draft", "draft").when(status.isin("deprecated", "archived"), "deprecated").otherwise("stable")


def stale_after(valid_until: Column, next_review: Column) -> Column:
    """The earlier of two dates as texts; a blank or null one doesn't count."""
    return F.least(F.nullif(valid_until, F.lit("")), F.nullif(next_review, F.lit("")))


#: Letters that decomposing leaves whole or that are written as one letter, and their plain forms.
FOLDED = {"ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "å": "a", "Å": "a", "ä": "a", "Ä": "a", "ö": "o", "Ö": "o", "ü": "u", "Ü": "u", "ß": "ss"}
#: Fixed value: a number at the head of a taxonomy name, and the rest.
SEGMENT = r"^(\d+(?:\.\d+)*\.?)\s*(.*)$"
#: Bodies with more words or lines have a map of their sections.
MAPPED_WORDS, MAPPED_LINES = 1000, 100


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Letters without their marks, other than ASCII dropped; decomposing has no built-in."""
    for letter, plain in FOLDED.items():
        text = text.str.replace(letter, plain, regex=False)
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def slug(text: Column) -> Column:
    """Letters and digits in lower case, joined by single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", "_"), "^_|_$", "")


def segment(name: Column) -> Column:
    """A taxonomy name as part of a path: its number, dots as underscores, then the slug of the rest."""
    plain = F.regexp_replace(name, r"^\s+|\s+$", "")
    number = F.regexp_replace(F.regexp_extract(plain, SEGMENT, 1), r"\.+$", "")
    rest = slug(F.when(number == "", plain).otherwise(F.regexp_extract(plain, SEGMENT, 2)))
    return F.when(number == "", rest).when(name.isNotNull(), F.concat_ws("_", F.replace(number, F.lit("."), F.lit("_")), F.nullif(rest, F.lit(""))))


def needs_section_map(body: Column) -> Column:
    """Whether a body is long: words between white space, lines between any kind of line end."""
    words = F.regexp_count(body, F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]+"))
    ends = r"(?:\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029])"
    lines = F.regexp_count(body, F.lit(ends)) + F.when((body == "") | body.rlike(ends + r"\z"), 0).otherwise(1)
    return (words > MAPPED_WORDS) | (lines > MAPPED_LINES)


@F.pandas_udf(_structs(chunk_index=T.IntegerType(), text=T.StringType(), word_count=T.IntegerType(), header=T.StringType()))
def markdown_chunks(text: pd.Series) -> pd.Series:
    """Passages by heading; sections of more than 512 words are packed by paragraph."""
    heading = re.compile(r"^#{1,6}\s+.*$", re.MULTILINE)

    def sections(body: str):
        at, header = 0, None
        for m in heading.finditer(body):
            yield header, body[at : m.start()].strip()
            at, header = m.end(), m.group().strip()
        yield header, body[at:].strip()

    def packed(content: str):
        held: list[str] = []
        for paragraph in content.split("\n\n"):
            found = paragraph.split()
            if held and len(held) + len(found) > 512:
                yield " ".join(held)
                held = []
            held = held + found
        if held:
            yield " ".join(held)

    def one(t):
        parts = (t or "").split("---", 2)
        body = (parts[2] if len(parts) > 2 else t or "").strip()
        out = []
        for header, content in sections(body):
            if not content:
                texts = [header] if header else []
            elif len(content.split()) <= 512:
                texts = [f"{header}\n\n{content}" if header else content]
            else:
                texts = [f"{header}\n\n{x}" if header else x for x in packed(content)]
            out += [(x, header) for x in texts]
        out = out or [(body, None)]
        return [{"chunk_index": i, "text": x, "word_count": len(x.split()), "header": h} for i, (x, h) in enumerate(out)]

    return text.map(one)


@F.pandas_udf(_structs(title=T.StringType(), start_line=T.IntegerType(), end_line=T.IntegerType(), words=T.IntegerType(), tokens=T.IntegerType()))
def section_map(text: pd.Series) -> pd.Series:
    """Second-level sections outside code fences, lines counted from 1, tokens about 1.3 a word."""

    def one(t):
        lines, found, fenced = (t or "").splitlines(), [], False
        for i, line in enumerate(lines, 1):
            fenced ^= line.lstrip().startswith("```")
            if line.startswith("## ") and not fenced:
                found.append([line[3:].strip(), i, i])
            elif found:
                found[-1][2] = i
        out = []
        for title, a, b in found:
            words = len(" ".join(lines[a - 1 : b]).split())
            out.append({"title": title, "start_line": a, "end_line": b, "words": words, "tokens": round(words * 1.3)})
        return out

    return text.map(one)
