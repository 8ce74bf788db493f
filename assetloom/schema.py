"""Fixed vocabularies, the category taxonomy and result schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

READY, REVIEW, FAILED = "READY", "REVIEW", "FAILED"

#: Category, print area, coverage lo/hi, holes expected, soft edges, displacement,
#: strand occluders, bounding-box fill lo/hi, aspect lo/hi, least quad fit.
TAXONOMY = [
    ("apparel", "torso", 0.10, 0.92, True, True, True, True, 0.34, 0.94, 0.45, 2.10, None),
    ("drinkware", "cylinder", 0.05, 0.75, True, False, False, False, 0.62, 1.00, 0.28, 1.90, None),
    ("wall_art", "quad", 0.08, 0.95, False, False, False, False, 0.78, 1.00, 0.25, 4.00, 0.95),
    ("accessory", "quad", 0.04, 0.90, True, False, True, False, 0.52, 1.00, 0.20, 4.50, None),
    ("auto", "quad", 0.03, 0.96, True, True, True, False, 0.25, 1.00, 0.15, 5.00, None),
]
TAXONOMY_SCHEMA = (
    "category string, print_area string, coverage_lo double, coverage_hi double, expect_holes boolean, soft_edges boolean, "
    "displacement boolean, strand_occluders boolean, fill_lo double, fill_hi double, aspect_lo double, aspect_hi double, quad_fit_min double"
)
CATEGORIES = [row[0] for row in TAXONOMY]

#: Other names of categories.
CATEGORY_ALIASES = {
    "apparel": ["tshirt", "t_shirt", "shirt", "hoodie", "clothing", "tote", "garment"],
    "drinkware": ["mug", "cup", "tumbler", "bottle"],
    "wall_art": ["canvas", "poster", "print", "wallart", "frame", "framed_print"],
    "accessory": ["phone_case", "case", "cap", "hat", "mousepad"],
}
#: Column names of manifests, in order of preference.
URL_COLUMNS = ["image_url", "url", "image", "src", "link", "base_url", "image_link"]
CATEGORY_COLUMNS = ["category", "product_type", "type", "product_category"]
SKU_COLUMNS = ["sku", "id", "code", "product_id", "base_id"]
#: The lists that a JSON manifest may hold its items in.
ENVELOPES = ["items", "images", "data", "rows", "bases"]
#: Suffixes of images, and names of colours that stand for others.
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff"]
COLOUR_ALIASES = {"lightblue": "light-blue", "lightyellow": "light-yellow", "lightgreen": "light-green", "blackwhite": "black-white", "black&white": "black-white"}

#: Weights of the quality terms.
WEIGHTS = {
    "edge_alignment": 0.20, "ensemble": 0.20, "boundary_contrast": 0.14, "sharpness": 0.12, "bg_consistency": 0.10,
    "topology": 0.10, "coverage": 0.07, "border": 0.05, "shape_prior": 0.02,
}

#: Columns of the flat results table.
RESULT_COLUMNS = [
    "id", "source", "status", "verdict", "confidence", "category", "category_source", "width", "height", "model", "total_ms",
    "coverage", "edge_sharpness", "ensemble_iou", "holes", "solidity", "border_contact", "print_area_kind",
    "print_area_confidence", "mask_file", "reasons", "error",
]

RESULT_SCHEMA = """
    idx int, id string, source string, status string, verdict string, confidence double, category string, category_source string,
    width int, height int, model string, timings_ms map<string,double>,
    metrics struct<coverage:double,edge_sharpness:double,uncertain_ratio:double,boundary_complexity:double,component_penalty:double,border_contact:double,ensemble_iou:double,holes:int,solidity:double>,
    print_area struct<kind:string,quad:array<array<double>>,bbox:array<double>,area_px:bigint,coverage_of_product:double,confidence:double>,
    mask_file string, reasons array<string>, error string
"""


@dataclass(frozen=True)
class Settings:
    """Thresholds and limits that change results."""

    ready_threshold: float = 0.82
    review_threshold: float = 0.55
    max_side: int = 6000
    min_side: int = 32
    max_upload_mb: float = 40
    retention_hours: float = 72
    history: int = 200

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Reads ``assetloom.<name>`` from the session; blank or malformed values keep the default."""
        given = {}
        for name, kind in (("ready_threshold", float), ("review_threshold", float), ("max_side", int), ("min_side", int), ("max_upload_mb", float), ("retention_hours", float), ("history", int)):
            try:
                given[name] = kind(spark.conf.get(f"assetloom.{name}", ""))
            except ValueError:
                continue
        return cls(**given)


def taxonomy(spark: SparkSession) -> DataFrame:
    """The category dimension: five rows."""
    return spark.createDataFrame(TAXONOMY, TAXONOMY_SCHEMA)
