"""Parameter sets.

The operators take domain values (companies, categories, thresholds) as
arguments.  The two profiles below bind them to the driver tables
(``/root/testdata/sf*``) so the same code runs the lead pipeline there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for results to match).
# Company -> operating company roll-up on the driver tables.
OPCO_MAP = {
    "OPCO_K": ["Brand#1", "Brand#2", "Brand#3", "Brand#4"],
    "OPCO_D": ["Brand#5", "Brand#6", "Brand#7", "Brand#8", "Brand#9", "Brand#10"],
}
# Dealer channel filters.
DEALER_YEARS = [1996, 1997, 1998, 1999, 2000]
L1_VALUES = ["STANDARD", "SMALL", "LARGE", "MEDIUM", "PROMO"]
L0_VALUES = ["L0_0", "L0_1", "L0_2"]
SPARE_PARTS = ["SPARE PARTS"]
COMMISSION_CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
PRODUCT_NUMBERS = [1, 2]
CUSTOMER_CLASS = "BUILDING"
# Direct channel.
DIRECT_YEARS = [2024]
DIRECT_TAG = "OPCO_N"
DIRECT_L1 = "DIRECT"
DIRECT_CLASS = "CUSTOMER"
# one list per profile; a repeated value is harmless
DIRECT_L2_MATCH = ["purchase", "error"]
DIRECT_L2_FEATURES = ["purchase", "signup", "click", "signup"]
# Years of the report by year.
REPORT_YEARS = [1998, 2024]
# Features.
PIVOT_VALUES = [
    "STANDARD STANDARD", "SMALL SMALL", "LARGE LARGE", "MEDIUM MEDIUM",
    "PROMO PROMO", "DIRECT purchase", "DIRECT signup", "DIRECT click",
]
TARGET_CATEGORY = "PROMO PROMO"
TARGET_THRESHOLD = 50000
WHISKER_K = 1.5
UNMATCHED_KEY = "Master-Unmatched"
NEAR_METRES = 5.0
EARTH_RADIUS_KM = 6371.0
SPLIT_WEIGHTS = [0.8, 0.2]
SEED = 42
LEAD_THRESHOLD_TEST = 0.75
LEAD_THRESHOLD_ALL = 0.25
TOP_FEATURES = 3
# Column-name cleaning: these characters become "_".
NAME_CHARS = [" ", ",", ";"]
# ---------------------------------------------------------------------------

# Output column of the capped target and of the label.
TARGET_OUT = "TARGET_SALES"
LABEL = "label"
KEY = "MDM_CUST_KEY"


@dataclass(frozen=True)
class SalesProfile:
    """Which rows of the two channels enter the unified sales fact."""

    name: str
    opco_map: dict = field(default_factory=lambda: OPCO_MAP)
    dealer_years: list = field(default_factory=lambda: DEALER_YEARS)
    l0_values: list = field(default_factory=lambda: L0_VALUES)
    l1_values: list = field(default_factory=lambda: L1_VALUES)
    # feature profile: L2 column is a copy of L1, the real L2 only sets the grain
    l2_from_l1: bool = False
    excluded_l2: list | None = None
    commission_classes: list = field(default_factory=lambda: COMMISSION_CLASSES)
    product_numbers: list = field(default_factory=lambda: PRODUCT_NUMBERS)
    customer_class: str = CUSTOMER_CLASS
    direct_years: list = field(default_factory=lambda: DIRECT_YEARS)
    direct_tag: str = DIRECT_TAG
    direct_l1: str = DIRECT_L1
    direct_l2_values: list = field(default_factory=lambda: DIRECT_L2_MATCH)
    direct_class: str = DIRECT_CLASS


MATCH = SalesProfile(name="match")
FEATURES = SalesProfile(name="features", l2_from_l1=True, excluded_l2=SPARE_PARTS,
                        direct_l2_values=DIRECT_L2_FEATURES)

# ---------------------------------------------------------------------------
# Fixed values of the enrichment step on the driver tables.
INSTALL_TYPES = ["PROMO", "STANDARD"]
CONTRACT_STATUS = "O"
TECH_EVENT_TYPE = "error"
ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# event types whose money an implant record shows in the lists, and the least value of the two user lists
IMPLANT_KINDS = ["purchase", "signup"]
IMPLANT_LEAST = 100.0
EVENT_TYPES = ["view", "click", "error", "purchase", "signup"]
RULE_SCORE_COLUMN = "MEDIUM MEDIUM"
RULE_SCORE_SCALE = 100000
FACT_CLASS = "BUILDING"
FACT_FEATURES = ["STANDARD_STANDARD", "SMALL_SMALL", "LARGE_LARGE", "DIRECT_purchase"]
CONTACT_COLS = ["ACCT_OFFICE_NAME", "ADDR_STREETADDR", "ADDR_CITY", "ADDR_STATE", "ADDR_ZIP",
                "CONT_FULLPHONE", "CONT_EMAIL"]
# Only these line numbers count as installed, so some customers have no install base.
INSTALL_LINES = [6, 7]
# Hyper-parameter grids of the model search, and its folds.
GBT_GRID = {"maxDepth": [2, 4], "maxIter": [10, 100]}
FOREST_GRID = {"maxDepth": [2, 5], "numTrees": [5, 10]}
FOLDS = 3
# ---------------------------------------------------------------------------
