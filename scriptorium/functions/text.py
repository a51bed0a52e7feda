"""Column expressions on text that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that no keyword statistic counts.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "这", "中", "大", "为", "上", "个", "到", "说", "们", "也", "会", "着", "要", "而", "去", "之", "过", "与",
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "shall", "can", "for", "and", "but", "or", "not", "no", "nor", "so", "yet", "to", "of", "in", "on", "at", "by", "from", "with", "as",
    "into", "about", "between", "through", "during", "before", "after", "above", "below", "this", "that", "these", "those", "it", "its", "they", "them",
    "their", "we", "our", "you",
]

# What marks a list of references.
REFERENCE_HEADING = r"(?im)^\s*(references?|参考文献|bibliography)\s*$"
REFERENCE_ENTRIES = [r"^\s*\[\d{1,3}\]\s+", r"^\s*\d{1,3}\.\s+[A-Z]", r"(?i)\bet al\.\b", r"(?i)\bdoi:\s*10\.\d{4,9}/"]
# For each of these, what a text has somewhere if a line of it, trimmed, is such an entry.
REFERENCE_TRACES = [r"\[\d{1,3}\]\s", r"(?m)^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]*\d{1,3}\.\s+[A-Z]", r"(?i)et al\.", r"(?i)doi:\s*10\."]

# Phrases of forms and declarations, and weaker hints of them.
ADMIN_PATTERNS = ["课程负责人签字", "研究生教育主管部门公章", "同意该课程资源按要求接入", "无违法违纪行为", "不存在师德师风问题", "学术不端", "思想导向正确", r"联系方式[:：]\s*\d{7,}"]
ADMIN_HINTS = ["签字", "公章", "真实性", "遵纪守法", "知识产权", "国家安全", "联系方式"]

# Fixed value: what is trimmed as a blank: ASCII blanks, the separators 1C to 1F, NEL, no-break and ideographic spaces, line and paragraph separators.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]"


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def clean_text(text: Column) -> Column:
    """Control characters go (but for newline and tab), runs of blanks shrink, lines and the whole are trimmed."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"(?U)[^\S\n]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+\z", "")


# What is replaced in Markdown by what, in this order: page numbers go, hyphenated line ends are joined, formula marks and table rules become uniform.
MARKDOWN_CLEANING = [
    (r"(?md)^\s*\d{1,4}\s*$", ""),
    (r"(?mdi)^.*Page\s+\d+\s+of\s+\d+.*$", ""),
    (r"-\n(\S)", "$1"),
    (r"(?d)\\\((.+?)\\\)", r"\$$1\$"),
    (r"(?s)\\\[(.+?)\\\]", r"\$\$$1\$\$"),
    (r"\|[\s:]*-{2,}[\s:]*", "| --- "),
    (r"\n{4,}", "\n\n\n"),
    (r"^\s+|\s+\z", ""),
]
# The marks of Markdown by what stands for them in plain text, in this order: headings, emphasis, images, links, tables, rules.
MARKDOWN_MARKS = [
    (r"(?md)^#{1,6}\s+", ""),
    (r"(?d)\*\*(.+?)\*\*", "$1"),
    (r"(?d)\*(.+?)\*", "$1"),
    (r"(?d)__(.+?)__", "$1"),
    (r"(?d)_(.+?)_", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\|", " "),
    (r"(?md)^[\s\-:]+$", ""),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]+", " "),
    (r"^\s+|\s+\z", ""),
]


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def clean_markdown(text: Column) -> Column:
    return _replaced(text, MARKDOWN_CLEANING)


def markdown_to_text(text: Column) -> Column:
    """Text without the marks of headings, emphasis, images, links and tables."""
    return _replaced(text, MARKDOWN_MARKS)


def is_reference_like(text: Column, head: int = 400, region_types: Column | None = None) -> Column:
    """A reference heading in the first characters, or three entries or more that are a fifth of the lines; or text from a region of references.

    region_types: the types of the layout regions that the text comes from, in either case. Null and empty texts are not like references.
    A text is cut into lines only if it has a trace of an entry anywhere.
    """
    regions = F.exists(region_types, lambda t: F.lower(t) == "reference") if region_types is not None else F.lit(False)
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]", -1), trim_blank), lambda x: F.length(x) > 0)
    entry = lambda x: x.rlike(REFERENCE_ENTRIES[0]) | x.rlike(REFERENCE_ENTRIES[1]) | x.rlike(REFERENCE_ENTRIES[2]) | x.rlike(REFERENCE_ENTRIES[3])
    hits = F.size(F.filter(lines, entry))
    traced = reduce(lambda a, b: a | b, [text.rlike(p) for p in REFERENCE_TRACES])
    listed = F.when(traced, (hits >= 3) & (hits >= 0.2 * F.size(lines))).otherwise(False)
    return F.coalesce(F.substring(text, 1, head).rlike(REFERENCE_HEADING) | listed, F.lit(False)) | F.coalesce((F.length(text) > 0) & regions, F.lit(False))


def is_admin_noise(text: Column) -> Column:
    """Two phrases of declarations, or three hints of them, in the first 1200 characters."""
    head = F.substring(text, 1, 1200)
    count = lambda tests: sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    strong = count([head.rlike(p) for p in ADMIN_PATTERNS])
    weak = count([F.contains(head, F.lit(h)) for h in ADMIN_HINTS])
    return F.coalesce((strong >= 2) | (weak >= 3), F.lit(False))


def normalize_doi(doi: Column) -> Column:
    return F.regexp_replace(F.trim(doi), r"^(https?://(dx\.)?doi\.org/)", "")


def extract_doi(text: Column) -> Column:
    """The first identifier of the form 10.dddd/…; null if there is none."""
    found = F.regexp_extract(text, r"(10\.\d{4,}/[^\s]+)", 1)
    return F.when(found != "", found)


def truncate_summary(text: Column, n: int = 500) -> Column:
    """A cut after n characters, drawn back to the last sentence end if that lies in the second half."""
    head = F.substring(text, 1, n)
    end = F.length(F.regexp_extract(head, r"(?s)^(.*[.。!！?？])", 1))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.when(end > n / 2, F.substring(head, F.lit(1), end)).otherwise(head), F.lit("...")))


def letters_or_ideographs(text: Column, most: str = "") -> Column:
    """Words of three Latin letters or more, and runs of two ideographs or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[a-zA-Z]{{3,}}|[\x{{4e00}}-\x{{9fff}}]{{2,{most}}}"), 0)
