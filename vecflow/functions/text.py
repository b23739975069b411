"""Text cleaning, tokens, chunks and ids as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns.
URL = r"(?i)https?://\S+|www\.\S+"
SPECIAL = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f.,!?]"
BLANKS = r"(?U)[\s\x1c-\x1f]+"
#: Runs of what SPECIAL and BLANKS take.
SPECIAL_OR_BLANKS = r"[^\p{L}\p{N}_.,!?]+"
TAG = r"<[^>]*>"

#: Categories in order of precedence, with the words that name them; the last is for all other texts.
CATEGORIES = {
    "Kinh doanh & Tài chính": ["chứng khoán", "tài chính", "ngân hàng", "xuất khẩu", "kinh tế", "doanh nghiệp", "usd", "giá cả", "lãi suất", "thương mại", "thị trường", "cổ phiếu"],
    "Khoa học & Công nghệ": ["công nghệ", "trí tuệ nhân tạo", "vi mạch", "bán dẫn", "robot", "máy tính", "phần mềm", "lưới điện", "mạng nơ ron", "thuật toán", "kỹ thuật số"],
    "Giáo dục": ["giáo dục", "đại học", "trường học", "sinh viên", "học sinh", "đào tạo", "giảng viên", "học bổng", "luận văn", "tiến sĩ", "học viện"],
    "Y tế & Sức khỏe": ["y tế", "bệnh viện", "bác sĩ", "dược phẩm", "chữa bệnh", "sức khỏe", "điều trị", "chẩn đoán", "phòng dịch", "thuốc", "y học"],
    "Giao thông & Xây dựng": ["giao thông", "cao tốc", "đường bộ", "ngập", "xe cộ", "hạ tầng", "cầu đường", "quy hoạch", "vận tải", "sân bay", "cảng biển"],
}
OTHER_CATEGORY = "Văn hóa & Đời sống"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def without_tags(c: Column) -> Column:
    """Tags become blanks; text without both brackets is left alone."""
    return F.when(c.contains("<") | c.contains(">"), F.regexp_replace(c, TAG, " ")).otherwise(c)


def normal(c: Column) -> Column:
    """Markup taken out as a parser reads it, and Unicode's composed form. Only texts that either can
    change leave the JVM, as Arrow batches."""
    from ..sources.html import strip_html  # which itself uses this module

    @F.arrow_udf("string")
    def parsed(texts: pa.Array) -> pa.Array:
        return pa.array([t and unicodedata.normalize("NFC", strip_html(t)) for t in texts.to_pylist()], pa.string())

    touched = c.contains("<") | c.contains(">") | ((F.octet_length(c) != F.length(c)) & c.rlike(r"[^\x{0}-\x{2ff}]"))
    return F.coalesce(parsed(F.when(touched, c)), c)


def nfc(c: Column) -> Column:
    """Unicode's composed form."""
    @F.arrow_udf("string")
    def composed(texts: pa.Array) -> pa.Array:
        return pa.array([t and unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return F.coalesce(composed(F.when(c.rlike(r"[^\x{0}-\x{2ff}]"), c)), c)


def without_urls(c: Column) -> Column:
    """Texts that hold neither of the signs that an address has are left alone."""
    may = c.contains("://")
    for sign in ("ww.", "wW.", "Ww.", "WW."):
        may = may | c.contains(sign)
    return F.when(may, F.regexp_replace(c, URL, " ")).otherwise(c)


def without_special(c: Column) -> Column:
    """Letters, digits, blanks and . , ! ? _ stay."""
    return F.regexp_replace(c, SPECIAL, " ")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def cleaned(c: Column, urls: bool = True, special: bool = True) -> Column:
    """The whole chain: markup, composed form, addresses, special characters, blanks; null becomes the
    empty text."""
    out = normal(text_or_empty(c))
    out = without_urls(out) if urls else out
    return F.trim(F.regexp_replace(out, SPECIAL_OR_BLANKS, " ")) if special else collapsed(out)


def cleaned_lines(c: Column) -> Column:
    """Control and zero-width signs go, blanks collapse in each line, empty lines go; line ends stay."""
    bare = F.regexp_replace(text_or_empty(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f​-‏﻿]", "")
    lines = F.transform(F.split(F.regexp_replace(bare, "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def tokens(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), BLANKS), lambda x: x != "")


def clean_tokens(c: Column) -> Column:
    """The same of a text that has single blanks only, as cleaned gives it."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def line(c: Column, n: int) -> Column:
    """The n-th line, from 1; null if there is none."""
    return F.try_element_at(F.split(c, "\n"), F.lit(n))


def short_hash(c: Column, algorithm: str = "sha256") -> Column:
    whole = {"sha256": F.sha2(c, 256), "sha1": F.sha1(c), "md5": F.md5(c)}[algorithm]
    return F.substring(whole, 1, 8 if algorithm == "md5" else 16)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a column in a lambda is computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(words: Column, k: int) -> Column:
    """Runs of k words, joined by blanks; null or fewer than k words give one short run."""
    return let(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " ")))


def shingles(words: Column, k: int) -> Column:
    """Runs of k words; the words themselves if there are fewer than k or k is at most 1."""
    return words if k <= 1 else F.when(F.size(words) < k, words).otherwise(runs(words, k))


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of a text's chunks: a tail of fewer than max(3, size // 4) words is no chunk,
    unless it is the only one."""
    step, least = max(size - overlap, 1), max(3, size // 4)
    many = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (n - s >= least))
    return F.when(n <= size, F.array(F.lit(0))).otherwise(many)


def category(c: Column) -> Column:
    out = F.lit(OTHER_CATEGORY)
    for name, words in reversed(CATEGORIES.items()):
        out = F.when(F.lower(c).rlike("|".join(words)), F.lit(name)).otherwise(out)
    return out


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def wikitext(c: Column) -> Column:
    """Templates, references and link targets go; link labels stay."""
    out = F.regexp_replace(c, r"\{\{[^{}]*\}\}", "")
    out = F.regexp_replace(out, r"(?s)<ref[^>]*/>|<ref[^>]*>.*?</ref>", "")
    out = F.regexp_replace(out, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    return collapsed(F.regexp_replace(out, "'{2,}", ""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def file_id(c: Column) -> Column:
    """The id in a file's address; anything without a slash is an id itself."""
    found = F.regexp_extract(c, "/(?:file/d/|id=)([a-zA-Z0-9_-]+)", 1)
    return F.when(c.contains("/") & (found != ""), found).otherwise(c)


def sql_escaped(c: Column) -> Column:
    """Backslashes and double quotes behind a backslash, single quotes twice; null is empty."""
    out = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("'"), F.lit("''"))
