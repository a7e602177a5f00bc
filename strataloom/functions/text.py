"""Tokenisers, stemmers and path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words without meaning of their own in questions about evidence.
ANCHOR_STOP_WORDS = tuple(
    """a an and are as at be been by can could did do does evidence exact for from had has have how if in into is it its may measured of on or propose prove proven
    related result should show source support that the their then there these they this those to use was were what when where which who why will with would""".split()
)
# The same for questions about relations.
QUESTION_STOP_WORDS = tuple(
    """a an and are as at be been by can could did do does for from had has have how if in into is it its may of on or should that the their then there these they
    this those to was were what when where which who why will with would""".split()
)
# Words that ask for a relation.
RELATION_WORDS = tuple("become bridge cause connect define derive improve improved incubated link promote propose related relation relationship support transform transition".split())
#: Ends of lines wherever Python ends them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"


def folded(text: Column) -> Column:
    """Lower case, with the sharp s as two letters; a null text is empty."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def _long(words: Column) -> Column:
    return F.filter(words, lambda w: F.length(w) > 1)


def name_words(name: Column) -> Column:
    """Distinct lower-case words of an identifier, longer than one letter."""
    spaced = F.regexp_replace(F.coalesce(name, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    return F.array_distinct(_long(F.transform(F.split(spaced, r"[_\s]+"), F.lower)))


def query_words(text: Column) -> Column:
    """Distinct words of a query or of metadata: runs of ASCII letters and digits, longer than one."""
    return F.array_distinct(_long(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9]+")))


def normalized_term(term: Column) -> Column:
    """A term without a plural ending (terms of more than four letters)."""
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)
    kept = term.endswith("ss") | term.endswith("us") | term.endswith("is")
    return F.when((F.length(term) > 4) & term.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((F.length(term) > 4) & term.endswith("s") & ~kept, cut(1)).otherwise(term)


def tokens(text: Column) -> Column:
    """All terms in order, normalised, of at least two letters."""
    words = F.regexp_extract_all(folded(text), F.lit("([a-z0-9]+)"), 1)
    return F.filter(F.transform(words, normalized_term), lambda w: F.length(w) >= 2)


def stem(term: Column) -> Column:
    """A relation term's stem: the first ending that fits is taken off."""
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)
    long = lambda n: F.length(term) > n
    kept = term.endswith("ss") | term.endswith("us") | term.endswith("is")
    return (
        F.when(long(7) & term.endswith("ness"), cut(4)).when(long(5) & term.endswith("ing"), cut(3)).when(long(4) & term.endswith("ed"), cut(2))
        .when(long(4) & term.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(long(4) & term.endswith("es"), cut(2)).when(long(3) & term.endswith("s") & ~kept, cut(1)).otherwise(term)
    )


def stems(text: Column) -> Column:
    """Stems of all terms in order, of at least two letters."""
    words = F.regexp_extract_all(folded(text), F.lit("([a-z0-9]+)"), 1)
    return F.filter(F.transform(words, stem), lambda w: F.length(w) >= 2)


def words_array(words) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.expr("array()").cast("array<string>")


def relation_terms(question: Column) -> Column:
    """Stems of a question that ask for a relation."""
    known = F.transform(words_array(RELATION_WORDS), stem)
    return F.filter(stems(question), lambda w: F.array_contains(known, w))


def bridge_terms(question: Column, source: Column, target: Column) -> Column:
    """Stems of a question that neither endpoint holds and that aren't stop words."""
    stop = F.transform(words_array(QUESTION_STOP_WORDS), stem)
    ends = stems(F.concat_ws(" ", source, target))
    return F.array_distinct(F.filter(stems(question), lambda w: ~F.array_contains(stop, w) & ~F.array_contains(ends, w)))


def lines(text: Column) -> Column:
    """Lines without their ends; no line follows a last line end. A null text has none."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes, without a byte order mark; invalid bytes are replaced."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^\\uFEFF", "")


def line_at(content: Column, offset: Column) -> Column:
    """The line (from 1) that a byte offset lies in."""
    before = F.substring(F.decode(content, "ISO-8859-1"), F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def is_plain_path(path: Column) -> Column:
    """Whether a path is relative, in canonical form and stays inside: no backslash, no '..'."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.rlike(r"(^|/)\.{0,2}(/|$)"), F.lit(False))


def ancestors(path: Column) -> Column:
    """The directories above a path, from the root ('') to its own."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def in_templates(path: Column) -> Column:
    return F.coalesce(F.array_contains(F.split(path, "/"), "_templates"), F.lit(False))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob of '*' (inside a part), '**' (over parts) and '?'."""
    import re

    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"
