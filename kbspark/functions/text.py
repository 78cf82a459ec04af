"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import DEFAULT_LANGUAGE, LANGUAGE_NAMES

HEADER = "SOURCE FILE: "


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a fixed mapping for a key."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def collapse_space(text: Column) -> Column:
    """Words joined by one space, without space at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def with_header(text: Column, source_file: Column) -> Column:
    return F.concat(F.lit(HEADER), source_file, F.lit("\n\n"), text)


def header_length(source_file: Column) -> Column:
    return F.length(F.concat(F.lit(HEADER), source_file, F.lit("\n\n")))


def without_headers(text: Column) -> Column:
    """Drop header lines and strip."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~strip(x).startswith(HEADER.rstrip()))
    return strip(F.array_join(lines, "\n"))


def token_estimate(text: Column) -> Column:
    """A quarter of the stripped length, at least 1, and 0 for no text."""
    length = F.length(strip(text))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(length / 4).cast("int")))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def chunk_id(doc: Column, level: str, start: Column, end: Column) -> Column:
    return F.concat_ws("_", doc, F.lit(level), start.cast("string"), end.cast("string"))


def page_hash(project: Column, kb: Column, source_file: Column, page: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (project, kb, source_file, page)]
    return F.md5(F.concat_ws("|", *parts))


def text_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def url_id(project: Column, url: Column) -> Column:
    return F.sha1(F.concat_ws("_", project, url))


# Characters a partition name may not hold (fixed value).
NAME_CHARACTERS = ' "#*+,./:<>?\\_|'
# One old partition name that stays valid (fixed value).
OLD_NAMES = {"text-embedding-3-large": "openai-3-large"}


def partition_name(model: Column, keep_old: bool = True) -> Column:
    plain = F.lower(F.translate(model, NAME_CHARACTERS, "-" * len(NAME_CHARACTERS)))
    return F.coalesce(lookup(OLD_NAMES, model), plain) if keep_old else plain


def header_base64(text: Column) -> Column:
    """Base64 in one line, as a header needs it."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")


def language_name(code: Column) -> Column:
    return F.coalesce(lookup(LANGUAGE_NAMES, code), F.lit(LANGUAGE_NAMES[DEFAULT_LANGUAGE]))


CONTEXT_TEMPLATE = "Answer in {language} and only from this context.\n\n<CONTEXT>\n{context}\n</CONTEXT>"


REWRITE_TEMPLATE = "Write the last question in {language} so that it can be understood without the conversation. Give the question only."


def rewrite_prompt(language: Column) -> Column:
    """The prompt that asks for a question to be rewritten; unknown languages get the default one's name."""
    return F.replace(F.lit(REWRITE_TEMPLATE), F.lit("{language}"), language_name(language))


def fill_template(template: str, context: Column, language: Column) -> Column:
    """Template with its context and the language name; text in the context is not a placeholder."""
    before, after = template.split("{context}")

    def named(part: str) -> Column:
        return F.replace(F.lit(part), F.lit("{language}"), language_name(language))

    return F.concat(named(before), context, named(after))


def rewritten_query(query: Column, history: Column, rewritten: Column) -> Column:
    """The rewritten query, or the query itself without history or when the rewrite failed."""
    return F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, query).otherwise(F.coalesce(rewritten, query))
