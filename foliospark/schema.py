"""Schemas, value domains and row checks of the document-region data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_TYPES = ("pdf", "image", "scanned_pdf", "multi_page_tiff", "unknown")
ENGINES = ("easyocr", "tesseract", "aws_textract", "paddleocr", "trocr", "layoutlmv3", "google_vision", "azure_vision")
REGION_TYPES = ("text", "title", "header", "paragraph", "list", "table", "figure", "caption", "footer", "unknown")
STRATEGIES = ("layout_aware", "confidence_based", "hybrid_semantic_layout", "table_preserving", "fixed_size")
QUALITY_LEVELS = ("excellent", "good", "acceptable", "poor", "unusable")
ISSUES = ("excessive_noise", "figure_detection_failed", "garbled_text", "language_detection_failed", "layout_errors", "low_confidence", "missing_text", "poor_image_quality", "rotation_issues", "scaling_issues", "table_extraction_failed")
STATUSES = ("cancelled", "chunking", "completed", "embedding_generation", "failed", "layout_analysis", "ocr_extraction", "pending", "preprocessing", "quality_assessment", "vector_indexing")

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BOX = _struct(x1=_D, y1=_D, x2=_D, y2=_D)
REGION = _struct(
    region_id=_S, doc_id=_L, page_number=_I, line_no=_I, text=_S, confidence=_D, x1=_D, y1=_D, x2=_D, y2=_D, region_type=_S,
    reading_order=_I, language=_S, font_size=_D, is_bold=_B, is_italic=_B, parent_region_id=_S, child_region_ids=T.ArrayType(_S),
)
TABLE_CELL = _struct(doc_id=_L, table_idx=_I, row=_I, col=_I, row_span=_I, col_span=_I, text=_S, confidence=_D, x1=_D, y1=_D, x2=_D, y2=_D)
PAGE = _struct(
    doc_id=_L, page_number=_I, engine=_S, width=_I, height=_I, language_detected=_S, overall_confidence=_D, text_coverage_ratio=_D, low_confidence_regions=_I,
    processing_time=_D, preprocessing_applied=T.ArrayType(_S), confidence_threshold=_D, processed_at=T.TimestampType(),
)
DOCUMENT = _struct(
    doc_id=_S, file_path=_S, content=T.BinaryType(), document_type=_S, created_at=T.TimestampType(), processed_at=T.TimestampType(),
    metadata=_struct(source=_S, title=_S, author=_S, creation_date=T.TimestampType(), page_count=_I, file_size=_L, language=_S, tags=T.ArrayType(_S), custom=T.MapType(_S, _S)),
)
ERROR = _struct(doc_id=_L, page_number=_I, step=_S, error_type=_S, message=_S, is_recoverable=_B, retry_count=_I)
ELEMENT = _struct(page_id=_L, pos=_I, type=_S, text=_S, coordinates=BOX)


@dataclass(frozen=True)
class ChunkerConfig:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 100
    confidence_threshold: float = 0.6
    preserve_headers: bool = True
    preserve_tables: bool = True
    preserve_lists: bool = True
    max_header_chunk_size: int = 500
    high: float = 0.8
    medium: float = 0.6
    low: float = 0.4
    separate_levels: bool = True
    variance_threshold: float = 0.2
    zero_is_missing: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError("confidence_threshold must be in [0, 1]")
        if self.chunk_size < 1 or self.chunk_overlap < 0 or self.min_chunk_size < 0:
            raise ValueError("sizes must not be negative")


@dataclass(frozen=True)
class ProcessingConfig:
    confidence_threshold: float = 0.7
    engines: tuple[str, ...] = ("easyocr",)
    preprocessing: tuple[str, ...] = ("noise_reduction", "contrast_enhancement", "deskew")
    max_resolution: int = 2400
    detect_tables: bool = True
    detect_figures: bool = True
    chunker: ChunkerConfig = field(default_factory=ChunkerConfig)

    ALLOWED = ("easyocr", "tesseract", "aws_textract", "google_vision", "azure_vision")

    def __post_init__(self) -> None:
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError("confidence_threshold must be in [0, 1]")
        if unknown := set(self.engines) - set(self.ALLOWED):
            raise ValueError(f"unknown engines: {sorted(unknown)}")


@dataclass(frozen=True)
class TextConfig:
    """Settings of the text-only pipeline."""

    confidence_threshold: float = 0.7
    chunk_size: int = 1000
    chunk_overlap: int = 200

    def __post_init__(self) -> None:
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError("confidence_threshold must be in [0, 1]")
        if self.chunk_size < 100:
            raise ValueError("chunk_size must be at least 100")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be under chunk_size")


def violations() -> Column:
    """What is wrong with a region row, as an array of names."""
    checks = {
        "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "width": ~F.coalesce(F.col("x2") > F.col("x1"), F.lit(False)),
        "height": ~F.coalesce(F.col("y2") > F.col("y1"), F.lit(False)),
        "text": F.col("text").isNull(),
        "region_id": F.col("region_id").isNull(),
    }
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda v: v.isNotNull())


def validate_regions(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with violations array)."""
    marked = regions.withColumn("violations", violations())
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)
