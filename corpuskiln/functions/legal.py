"""What questions and documents say about laws: numbers, articles, names, kinds, dates and titles.

Everything is a column expression over whole texts, so a table of questions or
documents is read in one pass.  The word lists and patterns are values of the
Vietnamese legal language that results depend on; rules around them are ours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskiln.functions import text as X

# Kinds of documents, by the code in their number and by name.
KIND_OF_CODE = {
    "QH": "Luật", "NQ": "Nghị quyết", "ND": "Nghị định", "NĐ": "Nghị định", "TT": "Thông tư",
    "QD": "Quyết định", "QĐ": "Quyết định", "CT": "Chỉ thị", "PL": "Pháp lệnh",
}
HEADINGS = {
    "CHI THI": "Chỉ thị", "CHỈ THỊ": "Chỉ thị", "THONG TU": "Thông tư", "THÔNG TƯ": "Thông tư", "NGHI DINH": "Nghị định", "NGHỊ ĐỊNH": "Nghị định",
    "NGHI QUYET": "Nghị quyết", "NGHỊ QUYẾT": "Nghị quyết", "QUYET DINH": "Quyết định", "QUYẾT ĐỊNH": "Quyết định", "LUAT": "Luật", "LUẬT": "Luật",
}
SPOKEN_KINDS = (" CHỈ THỊ", "NGHỊ ĐỊNH", "THÔNG TƯ", "NGHỊ QUYẾT", "QUYẾT ĐỊNH", " LUẬT")
KIND_WORDS = r"(?:Luật|Nghị\s*định|Thông\s*tư|Quyết\s*định|Chỉ\s*thị|Nghị\s*quyết)"

# Words that say nothing about a document's name or a question's topic.
NAME_NOISE = (
    "của trong theo về và các những được có cho với tại từ đến này đó luật nghị định thông tư quyết chỉ thị số năm ngày tháng"
).split()
TOPIC_NOISE = (
    "các của trong theo về và những được có cho với tại từ đến này đó gì nào thế như là bị quy định nói hỏi cách việt nam năm số ngày tháng điều khoản điểm luật nghị"
).split()
NUMBER_NOISE = TOPIC_NOISE + "tóm tắt nội dung tổng quan cho biết giới thiệu trình bày sau trước mới".split()

# Markers of what a question asks for.
FINE = ("mức phạt", "mức xử phạt", "phạt bao nhiêu", "bị phạt bao nhiêu", "bị phạt như thế nào", "bị phạt thế nào", "tiền phạt", "mức tiền phạt", "hình thức xử phạt")
AUTHORITY = ("thẩm quyền",)
SYNTHESIS = (
    "xử phạt vi phạm hành chính", "vi phạm hành chính", "không lập biên bản", "lập biên bản", "cưỡng chế", "quyết định xử phạt", "hình thức xử phạt", "theo luật",
    "theo nghị định", "quy định của pháp luật", "bao nhiêu", "là gì", "ở đâu", "như thế nào", "quy định thế nào", "văn bản nào", "theo văn bản nào", "gồm những yêu cầu",
    "gồm những nội dung", "trách nhiệm gồm những", "được quy định ở đâu", "tiếp nhận", "tin báo", "can thiệp",
)
PROCEDURAL = ("thủ tục", "quy trình", "hồ sơ", "thành phần hồ sơ", "giấy phép", "cấp phép", "đăng ký", "xin phép", "điều kiện")
CONDITION_GATE = ("điều kiện", "đủ điều kiện", "yêu cầu")
CONDITION_ACTIVITY = (
    "đăng ký", "thành lập", "cấp phép", "hoạt động", "giấy phép", "thủ tục", "xin phép", "mở cơ sở", "trợ giúp xã hội", "chứng nhận đủ điều kiện", "kinh doanh có điều kiện",
)
RESOURCES = ("cơ sở vật chất", "nhân lực", "trang thiết bị")
PROHIBITED = ("hành vi bị cấm", "các hành vi cấm", "trích xuất", "liệt kê")

# Patterns of numbers, dates, articles and kinds of questions.
NUMBER_IN_TEXT = r"(?iuU)\b(?:Luật\s*số|Số)\s*:\s*(\d+(?:\s*/\s*\d{4})?\s*/\s*[A-ZĐ]{1,6}(?:\s*-\s*[A-Z0-9Đ]{1,20})*(?:\s*\d{1,2})?)"
NUMBER_AS_FILE = r"^\s*(\d+)_(\d{4})_([A-Za-z][A-Za-z0-9\-]*)(?:_\d+)*\s*$"
NUMBER_WITH_SLASHES = r"(\d+/\d{4}/[A-Za-z0-9\-]+)"
NUMBER_GLUED = r"(?<!\d)(\d+?)(\d{4})?([A-ZĐ]{1,4})[-–]([A-Z0-9Đ]{1,20})(?:\s|$|[^A-Z0-9])"
ASKED_WITH_YEAR = r"(\d+/\d{4}/[A-ZĐa-zđ]{1,5}[-–][A-Z0-9Đa-zđ]{1,20})"
ASKED_WITHOUT_YEAR = r"(\d+/[A-ZĐa-zđ]{1,5}[-–][A-Z0-9Đa-zđ]{1,20})"
ASKED_WITHOUT_SLASH = r"(\d+)([A-ZĐ]{1,5})\s*[-–]\s*([A-Z0-9Đ]{1,20})"
ISSUED = r"(?iuU)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
EFFECTIVE = r"(?iuU)(?:có hiệu lực(?: thi hành)?(?: kể)?(?: từ)?|hiệu lực từ)\s+ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
ISSUER = r"(?iuU)^(BỘ|CHÍNH PHỦ|QUỐC HỘI|ỦY BAN|ỦY\s+BAN|UBND|HỘI ĐỒNG|TÒA ÁN|VIỆN KIỂM SÁT)\b"
NAME_ENDS = (
    r"(?siuU)\s+(?:điều|khoản|điểm|quy\s*định\s+(?:gì|về)|nói\s+gì|là\s+gì|xử\s*phạt|hướng\s*dẫn|sửa\s*đổi|bổ\s*sung"
    r"|có\s+bao\s+nhiêu|gồm\s+(?:những|các)|theo|bao\s+gồm)\b.*$"
)
GENERAL = r"(?iuU)(?:tóm\s*tắt|nội\s*dung|tổng\s*quan|cho\s*biết|giới\s*thiệu|trình\s*bày|liệt\s*kê|bao\s*gồm\s*(?:những|các)\s*gì)"
SEVERAL = r"(?iuU)(?:\bngành,?\s*nghề\s+đầu\s+tư\s+kinh\s+doanh\s+có\s+điều\s+kiện\b|\bdanh\s*mục\b|\bliệt\s*kê\b|\bbao\s*gồm\b|\bcác\s+điều\b|\bnhững\s+điều\b)"
AMENDING = r"(?iuU)sửa\s*đổi|bổ\s*sung"
COMPARED = (r"(?iuU)so sánh\s+(.+?)\s+(?:và|với|vs)\s+(.+?)(?:\s*$|\s*\.)", r"(?iuU)(?:khác nhau|khác biệt)\s+(?:giữa\s+)?(.+?)\s+(?:và|với)\s+(.+?)(?:\s*$|\s*\.)")
GLUED_IN_TEXT = r"(?iuU)\b(\d{2,4})(\d{4})((?:N[ĐD][-_]?CP)|(?:Q[ĐD][-_]?UBND)|(?:QH\d+))\b"


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _any(low: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return out


def _words(c: Column, noise: list[str]) -> Column:
    """Words of two letters or more that aren't noise, as written."""
    return F.filter(F.regexp_extract_all(c, F.lit("[a-zA-ZÀ-ỹĐđ]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*noise) & (F.length(w) > 1))


# Questions


def question_number(query: Column) -> Column:
    """The document number a question names: with a year, without one, or without slashes (then they are put in)."""
    plain = [_part(query, ASKED_WITHOUT_SLASH, i) for i in (1, 2, 3)]
    return F.coalesce(_part(query, ASKED_WITH_YEAR), _part(query, ASKED_WITHOUT_YEAR), F.concat(plain[0], F.lit("/"), plain[1], F.lit("-"), plain[2]))


def question_year(query: Column) -> Column:
    """The year that the first run of four digits or more says; a number that goes on (19951, 1995NĐ-CP) says none."""
    run = _part(query, r"(?U)([0-9]{4,}\w*)")
    return F.when(F.length(run) == 4, F.when(run.between("1990", "2030"), run.cast("int")))


def question_name(query: Column) -> Column:
    """The document name in a question: from its kind to a word that ends names, without year and question words."""
    tail = _part(query, rf"(?siuU)({KIND_WORDS}.*)$")
    name = F.trim(F.regexp_replace(tail, NAME_ENDS, ""))
    name = F.trim(F.regexp_replace(name, r"(?iuU)\s+(?:năm\s+)?\d{4}\s*$", ""))
    name = F.trim(F.regexp_replace(name, r"(?U)\s*[,?].*$", ""))
    name = F.trim(F.regexp_replace(name, r"(?iuU)(?:nào đó|nào khác|nào|gì)$", ""))
    return F.when(F.length(name) > 5, name)


def parsed_question(query: Column) -> Column:
    """struct(article, clause, point, name, year, number, general, several)."""
    return F.struct(
        _part(query, r"(?iuU)điều\s+(\d+[a-zA-Z]?)").alias("article"), _part(query, r"(?iuU)khoản\s+(\d+[a-zA-Z]?)").alias("clause"),
        _part(query, r"(?iuU)điểm\s+([a-zđ])").alias("point"), question_name(query).alias("name"), question_year(query).alias("year"),
        question_number(query).alias("number"), F.rlike(query, F.lit(GENERAL)).alias("general"), F.rlike(query, F.lit(SEVERAL)).alias("several"),
    )


def name_words(name: Column) -> Column:
    return _words(name, NAME_NOISE)


def topic_words(query: Column, name: Column) -> Column:
    """Words of a question's topic: what stands around the document's name."""
    rest = F.trim(F.replace(F.lower(query), F.lower(name), F.lit(" ")))
    return _words(rest, TOPIC_NOISE)


def topic_words_beside_number(query: Column, number: Column) -> Column:
    rest = F.regexp_replace(F.replace(query, number, F.lit(" ")), f"(?iuU){KIND_WORDS}", " ")
    return _words(rest, NUMBER_NOISE)


def compared_names(query: Column) -> Column:
    """struct(first, second) of the two things a question compares; the whole question and '' otherwise."""
    parts = [F.coalesce(*[_part(query, p, i) for p in COMPARED]) for i in (1, 2)]
    return F.struct(F.trim(F.coalesce(parts[0], query)).alias("first"), F.trim(F.coalesce(parts[1], F.lit(""))).alias("second"))


def question_flags(query: Column) -> dict[str, Column]:
    """What a question asks for, one boolean column each."""
    q = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    has = lambda *m: _any(q, m)
    fine, authority = _any(q, FINE), _any(q, AUTHORITY)
    article = F.rlike(q, F.lit(r"(?U)\bđiều\s+\d+[a-zA-Z]?\b"))
    synthesis = fine | article | authority | _any(q, SYNTHESIS) | (has("căn cứ pháp lý") & has("văn bản", "nào")) | (has("gồm những") & has("yêu cầu", "gì", "nội dung"))
    synthesis = synthesis | (has("điều kiện") & has("là gì")) | (has("thủ tục", "quy trình") & has("ở đâu", "như thế nào", "thế nào"))
    broad = (has("chính sách") & has("nhà nước", "quốc gia", "đối với", "của nước")) | (has("tiêu chí", "tiêu chi") & has("phân loại", "dự án", "trọng điểm", "quốc gia"))
    broad = (F.length(q) >= 12) & (broad | has("trọng điểm quốc gia", "quyền và nghĩa vụ", "nghĩa vụ và quyền"))
    asks_what = has("là gì", "gì", "như thế nào", "ra sao", "bao gồm")
    conditions = _any(q, CONDITION_GATE) & (_any(q, CONDITION_ACTIVITY) | (has("điều kiện") & asks_what) | (_any(q, RESOURCES) & has("yêu cầu", "điều kiện", "thế nào")))
    prohibited = has("nghiêm cấm") | (has("hành vi") & has("cấm")) | _any(q, PROHIBITED)
    return {
        "asks_fine": fine, "asks_authority": authority, "names_article": article, "needs_synthesis": synthesis, "is_procedural": _any(q, PROCEDURAL),
        "is_comprehensive": broad, "asks_conditions": conditions, "asks_prohibited": prohibited,
        "is_general": F.rlike(q, F.lit(GENERAL)), "wants_several": F.rlike(q, F.lit(SEVERAL)), "is_amendment": F.rlike(q, F.lit(AMENDING)),
    }


# Documents


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", "")


def document_number(stem: Column, text: Column) -> Column:
    """A document's number: from a file name with underscores, with slashes or glued, else from the
    first 3000 characters of the text, else the name itself."""
    under = [_part(stem, NUMBER_AS_FILE, i) for i in (1, 2, 3)]
    glued = [_part(stem, NUMBER_GLUED, i) for i in (1, 2, 3, 4)]
    code = F.concat(glued[2], F.lit("-"), glued[3])
    said = F.regexp_replace(_part(F.substring(text, 1, 3000), NUMBER_IN_TEXT), r"(?U)\s+", "")
    return F.coalesce(
        F.when(under[0].isNotNull(), F.concat_ws("/", *under)), _part(stem, NUMBER_WITH_SLASHES),
        F.when(glued[0].isNotNull(), F.concat_ws("/", glued[0], glued[1], code)), said, F.substring(stem, 1, 100),
    )


def all_numbers(text: Column) -> Column:
    """Every number announced in a text, in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_IN_TEXT), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, r"(?U)\s+", "")))


def _lines(text: Column, first: int) -> Column:
    """The filled ones of the first lines, up to a bar, trimmed."""
    some = F.slice(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n"), 1, first)
    return F.filter(F.transform(some, lambda ln: F.trim(F.substring_index(ln, "|", 1))), lambda ln: ln != "")


def document_kind(number: Column, stem: Column, text: Column, found: Column | None = None) -> Column:
    """The kind of a document: by the code in its number, by the third part of its file name, by a
    heading among the first 60 lines, by the first kind named in 1500 characters, else ``found``."""
    tail = F.split(F.element_at(F.split(F.upper(number), "/"), -1), r"[-\s]")[0]
    by_number, by_file = F.lit(None).cast("string"), F.lit(None).cast("string")
    part = F.get(F.split(F.upper(stem), "_"), F.lit(2))
    for code, kind in reversed(KIND_OF_CODE.items()):
        by_number = F.when(F.contains(number, F.lit("/")) & tail.startswith(code), kind).otherwise(by_number)
        by_file = F.when(F.contains(part, F.lit(code)), kind).otherwise(by_file)
    heads = F.transform(_lines(text, 60), lambda ln: F.trim(F.regexp_replace(F.upper(ln), r"(?U)[\s\-–—]+", " ")))
    names = F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])
    by_heading = F.get(F.filter(F.transform(heads, lambda h: names[h]), lambda k: k.isNotNull()), F.lit(0))
    start = F.concat(F.lit(" "), F.upper(F.substring(text, 1, 1500)))
    by_text = F.lit(None).cast("string")
    for said in reversed(SPOKEN_KINDS):
        by_text = F.when(F.contains(start, F.lit(said)), HEADINGS[said.strip()]).otherwise(by_text)
    return F.coalesce(by_number, by_file, by_heading, by_text, *([found] if found is not None else []), F.lit("Văn bản"))


def _date(text: Column, pattern: str, first: int) -> Column:
    return X.spoken_date(text, first, pattern)


def issued_date(text: Column) -> Column:
    return _date(text, ISSUED, 5000)


def effective_date(text: Column) -> Column:
    return _date(text, EFFECTIVE, 12000)


def _is_header(line: Column) -> Column:
    """Lines above a document's subject: number, motto, issuer, place and date, kind."""
    u = F.upper(line)
    about = F.contains(u, F.lit("VỀ VIỆC"))
    return (
        u.startswith("SỐ") | u.startswith("SO:") | F.contains(u, F.lit("CỘNG HÒA")) | (F.contains(u, F.lit("ĐỘC LẬP")) & F.contains(u, F.lit("TỰ DO")))
        | (~about & (F.contains(u, F.lit("ỦY BAN NHÂN DÂN")) | F.rlike(line, F.lit(ISSUER)))) | (F.rlike(line, F.lit(ISSUED)) & (F.length(line) < 120))
        | u.isin("CHỈ THỊ", "LUẬT", "NGHỊ ĐỊNH", "THÔNG TƯ", "NGHỊ QUYẾT", "QUYẾT ĐỊNH")
    )


def subject(text: Column, kind: Column) -> Column:
    """The subject of a document among its first 120 lines: a line that opens with 'V/v' or 'Về việc', else the line
    below the kind's label, else a line that holds 'về việc'; '' without one."""
    flat = lambda c: F.upper(F.regexp_replace(F.trim(c), r"(?U)\s+", " "))
    inner = r"(?iuU)^\d{1,3}[\.\)]\s+\S|^điều\s+\d+|^chương\s+[ivxlcdm\d]+"

    def found(lines: Column) -> Column:
        opens = F.filter(lines, lambda ln: F.rlike(ln, F.lit(r"(?iuU)^v[v／/]\s*\.\s*|^v/v\b|^về\s+việc\b")) & ~_is_header(ln))
        at = F.array_position(F.transform(lines, flat), flat(kind))
        below = F.filter(F.slice(lines, at.cast("int") + 1, F.size(lines)), lambda ln: (F.length(ln) >= 2) & ~F.rlike(ln, F.lit(inner)) & ~_is_header(ln))
        about = F.filter(lines, lambda ln: F.contains(F.upper(ln), F.lit("VỀ VIỆC")) & (F.length(ln) >= 12))
        return F.coalesce(F.get(opens, F.lit(0)), F.when(at > 0, F.get(below, F.lit(0))), F.get(about, F.lit(0)), F.lit(""))

    return X.let(_lines(text, 120), found)


def canonical_title(kind: Column, number: Column, issued: Column, about: Column) -> Column:
    """'Chỉ thị 06CT-UBND ngày 22052025 tăng cường ...'; null without a kind or number."""
    tail = F.trim(about)
    for opening in (r"(?iuU)^v[v／/]\s*\.\s*", r"(?iuU)^v/v\s+", r"(?iuU)^về\s+việc\s+"):
        tail = F.regexp_replace(tail, opening, "")
    compact = F.replace(F.regexp_replace(number, r"(?U)\s+", ""), F.lit("/"), F.lit(""))
    on = F.concat(F.lit("ngày "), F.date_format(issued, "ddMMyyyy"))
    return F.when((compact != "") & (kind != ""), F.concat_ws(" ", F.trim(kind), compact, on, F.nullif(F.lower(F.trim(tail)), F.lit(""))))


def unglued_numbers(text: Column) -> Column:
    """Numbers that lost their slashes get them back: 1472024NĐ-CP is 147/2024/NĐ-CP."""
    return F.regexp_replace(text, GLUED_IN_TEXT, "$1/$2/$3")


def repaired_number(number: Column) -> Column:
    """Stored numbers in one form: underscores as slashes, no spaces, glued ones taken apart."""
    return unglued_numbers(F.regexp_replace(F.replace(F.trim(number), F.lit("_"), F.lit("/")), r"(?U)\s+", ""))


def shown_date(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def document_label(kind: Column, number: Column, title: Column) -> Column:
    """'kind number', with the title when there is no number."""
    return F.when(F.coalesce(number, F.lit("")) != "", F.concat_ws(" ", F.nullif(kind, F.lit("")), number)).otherwise(F.coalesce(title, F.lit("")))


#: What a question asks for by its words.
EXPLAINING = ("là gì", "nghĩa là gì", "hiểu như thế nào", "giải thích", "định nghĩa", "khái niệm", "có nghĩa", "ý nghĩa", "như thế nào", "thế nào là")
COMPARING = ("so sánh", "khác nhau", "giống nhau", "đối chiếu", "khác gì", "điểm khác", "so với", "phân biệt", "sự khác biệt", "điểm giống")
BROAD = ("chính sách", "các quy định", "toàn bộ", "tất cả", "danh mục", "liệt kê", "những quy định", "các điều")


def query_features(query: Column, short: int = 30, long: int = 100) -> Column:
    """struct of the eleven features by which a way of retrieval is chosen: what a question names, what it asks for, its length."""
    q = X.strip(F.coalesce(query, F.lit("")))
    low, flags = F.lower(q), question_flags(q)
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    n = F.length(q)
    parts = {
        "has_article_ref": flags["names_article"], "has_clause_ref": F.rlike(q, F.lit(r"(?iuU)khoản\s+\d+")), "has_doc_number": F.rlike(q, F.lit(r"(?U)\d{2,}/\d{4}/[A-ZĐa-zđ0-9\-]+")),
        "is_procedure_like": flags["is_procedural"], "needs_explanation": says(EXPLAINING), "needs_comparison": says(COMPARING), "asks_fine_amount": flags["asks_fine"],
        "needs_broad_coverage": says(BROAD), "query_length": n, "is_short_query": n < short, "is_long_query": n > long,
    }
    return F.struct(*[c.alias(k) for k, c in parts.items()])
