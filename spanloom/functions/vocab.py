"""Vocabularies, fixed tables and schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Entity types in label order, assertions, and which types may carry what.
SYMPTOM, DIAGNOSIS, TEST, RESULT, DRUG = "TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "THUỐC"
TYPES = (SYMPTOM, DIAGNOSIS, TEST, RESULT, DRUG)
ASSERTIONS = ("isNegated", "isFamily", "isHistorical")
ASSERTION_TYPES = (SYMPTOM, DIAGNOSIS, DRUG)
CANDIDATE_TYPES = (DIAGNOSIS, DRUG)
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))

ENTITY = "struct<text:string,start:int,end:int,type:string,assertions:array<string>,candidates:array<string>,supervised:boolean>"
ENTITIES = f"array<{ENTITY}>"
NOTE = "id string, stem string, text string"
RECORD = f"id string, text string, entities {ENTITIES}, record_kind string, source string, genre string, source_case_id string"
FINDING = (
    "file string, entity_index int, kind string, mechanical boolean, rule string, reason string, source string, "
    "current struct<assertions:array<string>,type:string>, "
    "proposed struct<assertions:array<string>,type:string,text:string,start:int,end:int,delete:boolean>, "
    f"entity {ENTITY}, context struct<before:string,surface:string,after:string,window_start:int,heading:string>"
)
VERDICT = "id string, verdict string, assertions array<string>, type string, span string, reason string, model string, input_signature string"
DECISION = "key string, decision string"
PLAN = (
    "seed_id string, text string, semantic_type string, occurrence_index int, should_label boolean, type string, assertions array<string>, role string, "
    "provenance array<string>, occurrence_role string, gate_reason string, repeat_of string, order_hint string, covered_by string, assertion_cue_style string"
)
MENTION = "struct<seed_id:string,text:string,should_label:boolean,type:string,assertions:array<string>,context_evidence:string,rationale:string,position:array<int>>"
DRAFT = (
    "draft_id string, marked_text string, source_case_id string, track string, document_format string, section_path array<string>, text string, "
    f"mentions array<{MENTION}>, quality_flags array<string>, status string"
)
ROW_V1 = "tokens array<string>, ner_tags array<string>, assert_mask array<int>, assert_tags array<array<int>>, n_prefix int"

# Label map of the baseline tagger; labels that are not listed are dropped.
LABEL_MAP = {"DRUGCHEMICAL": DRUG, "DISEASESYMTOM": SYMPTOM, "DIAGNOSTICS": TEST, "UNITCALIBRATOR": RESULT}
DRUG_GROUP = ("DRUGCHEMICAL", "UNITCALIBRATOR")

# Surfaces that are headings or general words.
BLOCKED_SURFACES = (
    "triệu chứng", "triệu chứng hiện tại", "các triệu chứng hiện tại", "đặc điểm triệu chứng", "các triệu chứng", "triệu chứng khi khám",
    "chẩn đoán", "chẩn đoán khác", "các chẩn đoán", "các phát hiện chẩn đoán khác", "chẩn đoán hình ảnh", "kết quả chẩn đoán",
    "các kết quả chẩn đoán khác", "đánh giá", "đánh giá tại bệnh viện", "khám", "thăm khám", "khám lâm sàng", "xét nghiệm", "kết quả xét nghiệm",
    "kết quả", "kết quả khám lâm sàng", "nhập viện", "lý do nhập viện", "nhập viện:", "vào viện", "tiền sử", "tiền sử bệnh", "tiền sử bệnh nội khoa",
    "bệnh sử", "bệnh sử hiện tại", "lịch sử bệnh hiện tại", "tiền sử bệnh hiện tại", "thủ thuật", "các thủ thuật", "các thủ thuật đã thực hiện",
    "các thủ thuật thực hiện", "thủ thuật thực hiện", "bệnh nhân", "người bệnh", "bác sĩ", "thuốc", "thuốc trước khi nhập viện", "điều trị",
    "bệnh viện", "bệnh lý", "khoa", "cấp cứu", "mức độ", "tình trạng", "diễn biến", "các sự kiện", "sự kiện", "yếu tố nguy cơ",
    "các yếu tố nguy cơ liên quan", "n/a", "na", "không", "có", "mãn tính", "các bệnh lý mãn tính",
)

# Cues that support an assertion, cues that contradict its absence, and
# words after which one cue counts a quantity.
SUPPORT_CUES = {
    "isNegated": (
        "không", "chưa", "phủ nhận", "loại trừ", "hết", "âm tính với", "không còn", "không có", "không ghi nhận", "không thấy",
    ),
    "isHistorical": (
        "tiền sử", "trước đây", "trước đó", "trước kia", "đã từng", "từng bị", "từng được", "từng mắc", "từng có", "từng", "trong quá khứ",
        "bệnh án cũ", "hồ sơ cũ", "nhiều năm trước", "cách đây", "hồi", "lúc nhỏ", "đợt trước", "năm ngoái", "đã điều trị ổn định",
        "trong quá trình theo dõi trước",
    ),
    "isFamily": (
        "bố", "mẹ", "cha", "ba", "má", "ông", "bà", "anh trai", "chị gái", "em trai", "em gái", "người nhà", "gia đình", "con trai", "con gái",
        "cậu", "dì", "chú", "bác", "anh", "chị", "em", "họ hàng", "bên nội", "bên ngoại",
    ),
}
CONFLICT_CUES = {
    "isNegated": (
        "không", "chưa", "phủ nhận", "loại trừ", "không ghi nhận", "không có",
    ),
    "isHistorical": (
        "tiền sử", "trước đây", "đã từng", "từng bị", "từng mắc", "từng", "bệnh án cũ", "hồ sơ cũ",
    ),
}
NEGATION_AFTER = (
    "không", "chưa", "âm tính",
)
QUANTITY_CUE = "từng"
QUANTITY_WORDS = (
    "đợt", "bước", "loại", "người", "ngày", "lần", "cái", "mục", "phần", "cơn", "giai đoạn", "khoảng", "phút", "giờ", "tuần", "tháng", "năm",
    "chặng", "nhịp", "chút", "ít", "vùng", "bên", "chi",
)
YEAR_WORD = "năm"

# Phrases that speak about the text itself, and phrases and prefixes unsafe as surfaces.
META_PHRASES = (
    "không mô tả tình trạng", "không nói về đơn thuốc", "không nói về triệu chứng", "chỉ là thông tin minh họa", "chỉ mang tính minh họa",
    "nhằm minh họa", "thông tin này chỉ là", "chỉ là lưu ý chung", "lưu ý chung", "không cần gán nhãn", "intentional-o", "gán nhãn", "thuật ngữ này",
    "entity này", "các cụm như", "cụm từ", "cách nói", "cách gọi",
)
META_NOUNS = (
    "bệnh nhân", "bác sĩ", "thuốc", "xét nghiệm", "triệu chứng", "chẩn đoán", "kết quả",
)
UNSAFE_PHRASES = (
    "cần thêm thông tin", "triệu chứng của", "không phẫu thuật", "tập trung",
)
AMBIGUOUS_PREFIXES = (
    "bệnh sử", "cảm giác", "có ", "đi lại", "gắng sức", "hoạt động", "khám", "làm việc", "lo lắng", "người", "quan sát", "sinh hoạt", "theo dõi",
)

# Type weights of the reference labels and of sampling, assertion rates, density classes.
GOLD_WEIGHTS = dict(zip(TYPES, (0.39, 0.26, 0.15, 0.10, 0.10)))
SAMPLING_WEIGHTS = dict(zip(TYPES, (0.34, 0.26, 0.06, 0.18, 0.115)))
ASSERTION_RATE, ASSERTION_SPLIT = 0.22, {"isHistorical": 0.62, "isNegated": 0.36, "isFamily": 0.02}
DENSITY_CLASSES = (("sparse", 6, 10, 0.32, 0.10), ("normal", 11, 16, 0.44, 0.22), ("dense", 17, 25, 0.24, 0.28))


def listed(values: Sequence[str]) -> list[str]:
    """The members of a table: those of a sequence, or the parts of a text with a comma and a blank between them."""
    return [x.strip() for x in values.split(",")] if isinstance(values, str) else list(values)


def type_table(spark: SparkSession) -> DataFrame:
    """One row for each type with its order and what it allows."""
    rows = [(t, i + 1, t in ASSERTION_TYPES, t in CANDIDATE_TYPES) for i, t in enumerate(TYPES)]
    return spark.createDataFrame(rows, "type string, ord int, allows_assertion boolean, allows_candidate boolean")


def type_id(kind: Column) -> Column:
    """The number of a type from 1, 0 for any other."""
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), kind).cast("int")


def entity(text: Column, start: Column, end: Column, kind: Column, assertions: Column, candidates: Column | None = None, supervised: Column | None = None) -> Column:
    return F.struct(
        text.alias("text"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        kind.alias("type"),
        assertions.alias("assertions"),
        (F.array().cast("array<string>") if candidates is None else candidates).alias("candidates"),
        (F.lit(True) if supervised is None else supervised).alias("supervised"),
    )
