"""Column functions over text: cleaning, tokens, names, truncation and rendering. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The placeholder and the patterns that results depend on.
IMAGE_PLACEHOLDER = "[图片]"
DATA_URI_PATTERNS = (
    r"(?i)<img\b[^>]*?data:[^>]*?>",
    r"(?i)!\[[^\]]*\]\(\s*data:[^)]*\)",
    r"(?i)data:[a-zA-Z0-9.+-]+/[a-zA-Z0-9.+-]+;base64,[A-Za-z0-9+/=_-]{64,}",
)
PAGE_NUMBER_PATTERNS = (
    r"\s*-\s*\d+\s*-\s*",
    r"\s*第\s*\d+\s*页\s*",
    r"\s*Page\s+\d+\s*(of\s+\d+)?\s*",
    r"\s*\d+\s*/\s*\d+\s*",
    r"\s*\d{1,4}\s*",
)
HEADING = r"(?m)^#{1,6}\s+"
# Marks at which a text has structure.
STRUCTURE_MARKS = (
    r"^[一二三四五六七八九十]+[、．.]",
    r"^（[一二三四五六七八九十]+）",
    r"^\([一二三四五六七八九十]+\)",
    r"^\d+[、．.\s]",
    r"^(原告|被告|第三人|诉讼请求|事实与理由|事实和理由|证据目录|证据清单|判决如下|裁定如下|本院认为|经审理查明|审判长|审判员)",
    r"^第[一二三四五六七八九十百千\d]+[条章节款项]",
    r"^\[(?:Non-Text|Image|Figure|Chart|Table)\]",
)
# Level and pattern of headings in texts without Markdown headings, and the longest that is a heading.
PLAIN_HEADINGS = (
    (1, r"^[^\S\n]*(第[一二三四五六七八九十百千零〇\d]+[章编](?:[^\S\n]+\S.*)?)$"),
    (2, r"^[^\S\n]*(第[一二三四五六七八九十百千零〇\d]+[节節部]分?(?:[^\S\n]+\S.*)?)$"),
    (1, r"(?i)^[ \t]*((?:Chapter|Section|Part)\s+(?:\d+|[IVXLCDM]+)\b.*)$"),
    (1, r"(?i)^[ \t]*((?:Kapitel|Abschnitt|Teil)\s+(?:\d+|[IVXLCDM]+)\b.*)$"),
    (2, r"^[ \t]*([一二三四五六七八九十]+、\s*\S.*)$"),
)
LONGEST_HEADING = 40
# Level and pattern of the headings that make up a section path, as whole lines.
SECTION_HEADINGS = (
    (4, r"####[^\S\n]+(.+)"),
    (3, r"###[^\S\n]+(.+)"),
    (2, r"##[^\S\n]+(.+)"),
    (1, r"#[^\S\n]+(.+)"),
    (1, r"[^\S\n]*(第[一二三四五六七八九十百千\d]+[章编])(?:[^\S\n]+\S[^\n]*)?"),
    (2, r"[^\S\n]*(第[一二三四五六七八九十百千\d]+[节部]分?)(?:[^\S\n]+\S[^\n]*)?"),
    (2, r"[^\S\n]*([一二三四五六七八九十]+)、([^\n]+)"),
    (3, r"[^\S\n]*[（\(]([一二三四五六七八九十]+)[）\)]([^\n]+)"),
    (4, r"[^\S\n]*(\d+\.\d+\.\d+)[^\S\n]+([^\n]+)"),
    (3, r"[^\S\n]*(\d+\.\d+)[^\S\n]+([^\n]+)"),
    (2, r"[^\S\n]*(\d+)\.[^\S\n]+([^\n]+)"),
    (4, r"[^\S\n]*(\d+)[）\)][^\S\n]*([^\n]+)"),
)
# What a heading or label without content says.
FRAGMENTS = ("原告", "被告", "第三人", "诉讼请求", "事实与理由", "事实和理由", "证据目录", "证据清单", "判决如下", "裁定如下", "本院认为", "经审理查明", "审判长", "审判员", "目录", "附录", "附件", "备注", "注", "说明")
# Words of questions about a whole library, and names that no file may have.
GLOBAL_KEYWORDS = (
    "整体", "总体", "总的来说", "总结", "汇总", "概括", "概述", "综述", "归纳", "主旨", "主题", "大致", "大体", "整个", "整本", "全书", "所有", "全部",
    "主要内容", "主要讲", "讲了什么", "讲什么", "说了什么", "关于什么", "是什么内容", "核心内容", "涵盖", "包含哪些", "有哪些主题", "这个库", "知识库", "文档集", "资料库",
    "overall", "summary", "summarize", "summarise", "summarize the", "overview", "in general", "main theme", "main topic", "what is this about", "gist", "broadly",
)
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
WEB_TITLE = "网页内容"


def strip_data_uris(text: Column) -> Column:
    """Inline base64 images become a placeholder."""
    for p in DATA_URI_PATTERNS:
        text = F.regexp_replace(text, p, IMAGE_PLACEHOLDER)
    return text


def is_page_number(line: Column) -> Column:
    return line.rlike("(?i)^(" + "|".join(PAGE_NUMBER_PATTERNS) + ")$")


def remove_page_numbers(text: Column) -> Column:
    """Lines that hold only a page number go."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_page_number(x)), "\n")


def tokens(text: Column) -> Column:
    """K1: distinct lower-case tokens; white space splits, CJK runs become character pairs, single characters and punctuation go."""
    lower = F.lower(F.trim(text))
    spaced = F.filter(F.split(lower, r"(?U)\s+"), lambda w: (F.length(w) > 1) & ~w.rlike(r"^[\p{P}\p{S}]+$"))
    letters = F.split(lower, "")
    pairs = F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(F.size(letters), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    pairs = F.filter(pairs, lambda w: (F.length(w) > 1) & ~w.rlike(r"[\s]|^[\p{P}\p{S}]+$"))
    return F.array_distinct(F.when(lower.rlike("[一-鿿]"), pairs).otherwise(spaced))


def strip_think(text: Column) -> Column:
    """K3"""
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def head_tail(text: Column, limit: int) -> Column:
    """K4: keeps two fifths of each end of a text over the limit."""
    n = F.length(text)
    side = F.floor(n * 0.4).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), side), F.lit("[...truncated "), (n - 2 * side).cast("string"), F.lit(" chars...]"), F.substring(text, n - side + 1, side))
    return F.when(n <= limit, text).otherwise(cut)


def rough_tokens(text: Column) -> Column:
    """K5 (a)"""
    return F.greatest(F.floor(F.length(text) / 2), F.lit(1)).cast("long")


def script_tokens(text: Column) -> Column:
    """K5 (b): ASCII letters count a quarter, others two thirds."""
    ascii_n = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.floor((F.length(text) - ascii_n) / 1.5 + ascii_n / 4), F.lit(1))).cast("long")


def message_tokens(text: Column) -> Column:
    """K5 (c): a quarter of the length and three a message."""
    return (F.floor(F.length(F.coalesce(text, F.lit(""))) / 4) + 3).cast("long")


def safe_filename(title: Column, longest: int = 120) -> Column:
    """K12"""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r'[/\\<>:"|?*\x00-\x1f]', " "), r"(?U)\s+", " ")
    name = F.regexp_replace(F.trim(name), r"^\.+|\.+$", "")
    name = F.when(name == "", F.lit(WEB_TITLE)).otherwise(F.regexp_replace(F.regexp_replace(F.substring(name, 1, longest), r"\s+$", ""), r"^\.+|\.+$", ""))
    return F.concat(name, F.lit(".md"))


def name_problem(name: Column, longest: int = 255) -> Column:
    """C14: why a file name is refused; null if it is fine."""
    clean = F.trim(name)
    return (
        F.when(clean == "", "empty")
        .when(F.length(clean) > longest, "too long")
        .when(clean.rlike(r'[/\\<>:"|?*\x00-\x1f]'), "forbidden character")
        .when(clean.endswith("."), "ends with a dot")
        .when(F.upper(F.split_part(clean, F.lit("."), F.lit(1))).isin(*RESERVED_NAMES), "reserved")
    )


def collection_dim(name: Column) -> Column:
    """The dimension at the end of a collection's name."""
    return F.regexp_extract(name, r"_(\d+)$", 1).try_cast("int")


def one_line(text: Column) -> Column:
    """K14"""
    return F.translate(text, "\r\n\t", "   ")


def xml_escape(text: Column) -> Column:
    """K16"""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def result_count(output: Column) -> Column:
    """Of a tool's output: its count attribute, else its result tags, else its lines."""
    attribute = F.regexp_extract(output, r'count="(\d+)"', 1)
    tags = F.regexp_count(output, F.lit(r"<(result|chunk|document)\b"))
    lines = F.size(F.filter(F.split(output, "\n"), lambda x: F.trim(x) != ""))
    return F.when(attribute != "", attribute.try_cast("long")).when(tags > 0, tags.cast("long")).otherwise(lines.cast("long"))


def without_prefix(text: Column) -> Column:
    """Without a leading [title]."""
    return F.regexp_replace(text, r"^\[[^\]]*\]\s*", "")


def is_global_query(query: Column) -> Column:
    """K10"""
    low = F.lower(query)
    out = F.lit(False)
    for k in GLOBAL_KEYWORDS:
        out = out | low.contains(k)
    return out


def backoff_seconds(attempt: Column) -> Column:
    """K18"""
    return F.pow(F.lit(2.0), attempt - 1)


def is_fragment(content: Column) -> Column:
    """A short text that is only a heading word."""
    return (F.length(F.trim(content)) < 15) & F.trim(content).isin(*FRAGMENTS)


def profile(text: Column) -> dict[str, Column]:
    """Structural measurements of a text."""
    paragraphs = F.size(F.filter(F.split(text, r"\n\n+"), lambda p: F.trim(p) != ""))
    return {
        "heading_count": F.regexp_count(text, F.lit(HEADING)).cast("long"),
        "structure_count": F.regexp_count(text, F.lit("(?m)" + "|".join(STRUCTURE_MARKS))).cast("long"),
        "paragraph_count": paragraphs.cast("long"),
        "total_chars": F.length(text).cast("long"),
        "avg_paragraph_len": F.when(paragraphs > 0, F.length(text) / paragraphs).otherwise(F.length(text).cast("double")),
    }


def paragraphs(text: Column) -> Column:
    """I10"""
    return F.filter(F.transform(F.split(text, r"\n\n+"), lambda p: F.trim(p)), lambda p: p != "")


def element_type(content: Column) -> Column:
    """Table if most lines look like rows, title if short and like a heading, else text."""
    lines = F.filter(F.split(F.trim(content), "\n"), lambda x: F.trim(x) != "")
    rows = F.filter(lines, lambda x: (F.length(x) - F.length(F.replace(x, F.lit("|"))) >= 2) | (F.length(F.trim(x)) - F.length(F.replace(F.trim(x), F.lit("\t"))) >= 2))
    title = F.trim(content).rlike(r"(?m)\A(?:" + "|".join(p for _, p in SECTION_HEADINGS) + ")$")
    return F.when(F.size(rows) > F.size(lines) * 0.5, "table").when((F.length(F.trim(content)) < 100) & (F.size(lines) <= 2) & title, "title").otherwise("text")


def embed_text(header: Column, child: Column, filename: Column, path: Column, parent: Column) -> Column:
    """What is embedded for a child chunk."""
    context = F.trim(F.substring(parent, 1, 150))
    prefix = F.concat(F.lit("["), F.array_join(F.concat(F.array(filename), F.coalesce(path, F.array().cast("array<string>"))), " | "), F.lit("]"))
    plain = F.concat_ws("\n", prefix, F.when((context != "") & (context != F.substring(child, 1, 150)), context), child)
    return F.when(F.coalesce(header, F.lit("")) != "", F.concat(header, F.lit("\n\n"), child)).otherwise(plain)


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def index_content(filename: Column, child: Column) -> Column:
    """I23"""
    return F.concat(F.lit("["), stem(filename), F.lit("] "), child)


def title_and_body(text: Column) -> dict[str, Column]:
    """The first line with text, and the rest."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return {"title": F.coalesce(F.trim(F.try_element_at(lines, F.lit(1))), F.lit("")), "body": F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), "\n")}


def byte_limit(text: Column, limit: int) -> Column:
    """B2: the longest prefix of whole characters within a number of UTF-8 bytes."""
    raw = F.encode(text, "UTF-8")
    inner = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")  # noqa: E731  a byte inside a character
    cut = F.lit(limit - 3)
    for k in (2, 1, 0):
        cut = F.when(~inner(limit + 1 - k), limit - k).otherwise(cut)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


# A private character, and what stands after it for itself and for the letters that tables begin with.
QUOTE = "\ue000"
QUOTED = ((QUOTE, "e"), ("|", "p"), ("<", "l"))


def quoted(text: Column) -> Column:
    """A text that no split at tables cuts or strips: it holds no mark of a table and stands between two marks of its own; a null is a mark of its own."""
    out = text
    for letter, code in QUOTED:
        out = F.replace(out, F.lit(letter), F.lit(QUOTE + code))
    return F.coalesce(F.concat(F.lit(QUOTE + "("), out, F.lit(QUOTE + ")")), F.lit(QUOTE + "0"))


def unquoted(text: Column) -> Column:
    """What quoted() was given."""
    out = F.substring(text, F.lit(3), F.length(text) - 4)
    for letter, code in reversed(QUOTED):
        out = F.replace(out, F.lit(QUOTE + code), F.lit(letter))
    return F.when(text != QUOTE + "0", out)
