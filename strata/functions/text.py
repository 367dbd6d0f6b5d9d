"""Text functions as Spark Column expressions (JVM-side, no Python per row).

Python's ``str.strip``/``split`` and ``re`` classes are Unicode-aware, Spark's ``trim`` is
not, so whitespace here is the class ``WS`` (Java ``\\s`` plus the extra code points Python
treats as space). Python's ``\\w`` and ``\\d`` on str are spelled ``W``/``D`` below, ``\\b`` as lookarounds on
``W``, and ``(?d)`` makes only ``\\n`` end a line, as in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NON_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"
W = r"[\p{L}\p{N}_]"      # Python's \w on str
D = r"\p{Nd}"              # Python's \d on str
# sentence pieces: text up to and including one of . ! ? newline, or an unterminated tail
SENTENCE_RE = r"(?d)[^.!?\n]*[.!?\n]|[^.!?\n]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(x: Column, fn) -> Column:
    """Bind ``x`` once for ``fn`` (``transform`` over a one-element array): expressions have no let, and a
    value that an expression names several times is otherwise computed as often, in a pushed-down
    filter once more."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def once(c) -> Column:
    """``c``, computed by its own projection alone. Catalyst copies a deterministic expression into every
    filter that it pushes below the projection and into every projection that it merges with it; a parse
    or a regular expression over a whole text is then done as often."""
    return F.when(F.monotonically_increasing_id() >= 0, _c(c))


#: The characters of ``WS``.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def ustrip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends. Trimmed by a list of characters: a regular
    expression would look for the end's whitespace from every place of the text."""
    return F.btrim(_c(c), F.lit(SPACES))


def ustrip_long(c) -> Column:
    """``ustrip`` for a long text held in a column: the edge characters are tested first, so
    a text without edge whitespace is not copied."""
    def strip(x):
        edge = F.lit(False)
        for ch in SPACES:  # the end is compared as bytes: no character of the text is counted
            edge = edge | x.startswith(ch) | x.endswith(ch)
        return F.when(edge, ustrip(x)).otherwise(x)
    return let(_c(c), strip)


def words(c) -> Column:
    """Python ``str.split()``: whitespace-separated tokens (empty array for blank text)."""
    return F.regexp_extract_all(_c(c), F.lit(f"{NON_WS}+"), 0)


def word_count(c) -> Column:
    return F.size(words(c))


def collapse_ws(c) -> Column:
    """``' '.join(s.split())``: every whitespace run becomes one ASCII space, so the plain
    (ASCII-space) trim is exact afterwards."""
    return F.trim(F.regexp_replace(_c(c), f"{WS}+", " "))


def is_blank(c) -> Column:
    return ustrip(c) == F.lit("")


def strip_code_fence(c) -> Column:
    """Strip, then drop a leading json code fence and a trailing fence (no re-strip)."""
    head = len(K.CODE_FENCE_OPEN)
    tail = len(K.CODE_FENCE_CLOSE)
    opened = let(ustrip_long(c), lambda s: F.when(s.startswith(K.CODE_FENCE_OPEN), F.substring(s, head + 1, 1 << 30)).otherwise(s))
    return let(opened, lambda s: F.when(s.endswith(K.CODE_FENCE_CLOSE),
                                        F.left(s, F.length(s) - F.lit(tail))).otherwise(s))


def clean_filename(c) -> Column:
    """File-name normalisation for near-duplicate detection, rules in the reference order:
    lower; drop '(pdf)'; drop a trailing '.pdf'; drop 4-digit years; drop a leading article;
    drop parenthesised text; non-word characters to space; collapse spaces; drop stop words."""
    s = F.lower(_c(c))
    s = F.regexp_replace(s, r"(?i)\(pdf\)", "")
    s = F.regexp_replace(s, r"(?i)(?d)\.pdf$", "")
    s = F.regexp_replace(s, rf"(?<!{W}){D}{{4}}(?!{W})", "")
    s = F.regexp_replace(s, rf"^(the|a|an){WS}+", "")
    s = F.regexp_replace(s, r"\([^)]*\)", "")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]", " ")
    s = collapse_ws(s)
    stop = F.array(*[F.lit(w) for w in K.NAME_STOP_WORDS])
    return F.array_join(F.filter(F.split(s, " "), lambda w: ~F.array_contains(stop, w)), " ")


def clean_content(c) -> Column:
    """Evidence-line cleaning: figure/table captions, parenthesised dates, trailing page
    numbers, number-only lines, then whitespace collapse and strip."""
    s = _c(c)
    s = F.regexp_replace(s, rf"(?d)Fig\.{WS}*{D}+.*?\n", "")
    s = F.regexp_replace(s, rf"(?d)Table{WS}*{D}+.*?\n", "")
    s = F.regexp_replace(s, rf"\({W}+{WS}+{D}{{1,2}}{WS}+{W}+{WS}+{D}{{4}}\)", "")
    s = F.regexp_replace(s, rf"(?d){D}+{WS}*$", "")
    s = F.regexp_replace(s, rf"(?d)(?m)^{WS}*{D}+{WS}*$", "")
    return collapse_ws(s)


def basename(c) -> Column:
    return F.element_at(F.split(_c(c), "/"), -1)


def source_label(c) -> Column:
    """Display label of a source path: its base name without the extraction suffix."""
    return F.replace(basename(c), F.lit(K.EXTRACTION_SUFFIX), F.lit(""))


def file_stem(c) -> Column:
    """Base name without its last extension (a leading dot is not an extension)."""
    return F.regexp_replace(basename(c), r"(?d)(.)\.[^.]*$", "$1")


def extraction_output_name(c) -> Column:
    return F.concat(file_stem(c), F.lit(K.EXTRACTION_SUFFIX))


def is_question(c) -> Column:
    return F.lower(_c(c)).rlike("^(" + "|".join(K.QUESTION_WORDS) + ")")


def sentences(c) -> Column:
    """Sentence pieces cut after . ! ? or newline, stripped, empties dropped."""
    pieces = F.regexp_extract_all(_c(c), F.lit(SENTENCE_RE), 0)
    return F.filter(F.transform(pieces, ustrip), lambda s: s != F.lit(""))


def first_sentence(c) -> Column:
    """``sentences(c)[0]`` (or '') without cutting the whole text: a piece is empty after
    strip only when it is whitespace ending in a newline, so the first non-empty piece starts
    after the leading whitespace."""
    first = F.regexp_extract(_c(c), rf"(?d)^{WS}*([^.!?\n]*[.!?\n]|[^.!?\n]+$)", 1)
    return F.coalesce(ustrip(first), F.lit(""))


def html_to_text(c) -> Column:
    """Markup removal for page text: scripts, styles, comments, tags, five basic entities."""
    s = F.regexp_replace(_c(c), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return s
