"""A demo filing of three statements, as rows of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The demo filing's lines as (level, label, values by period), in order.
INCOME_PERIODS = ["2023", "2024", "2025"]
INCOME = [
    (0, "Net revenue", 7426, 7562, 7463),
    (0, "Cost of revenue", -1792, -1710, -1543),
    (0, "Gross profit", 5634, 5852, 5920),
    (0, "Operating expenses:", None, None, None),
    (1, "Research and development", -2328, -2420, -2569),
    (1, "Marketing and sales", -978, -1019, -962),
    (1, "General and administrative", -727, -691, -745),
    (1, "Amortization and impairment of intangibles", -158, -142, -67),
    (1, "Restructuring (See Note 8)", -111, -62, -57),
    (0, "Total operating expenses", -4302, -4334, -4400),
    (0, "Operating income", 1332, 1518, 1520),
    (0, "Interest and other income (expense), net", -6, 71, 85),
    (0, "Income before provision for income taxes", 1326, 1589, 1605),
    (0, "Provision for income taxes", -524, -316, -484),
    (0, "Net income", 802, 1273, 1121),
    (0, "Earnings per share:", None, None, None),
    (1, "Basic", 2.90, 4.71, 4.28),
    (1, "Diluted", 2.88, 4.68, 4.25),
    (0, "Number of shares used in computation:", None, None, None),
    (1, "Basic", 277, 270, 262),
    (1, "Diluted", 278, 272, 264),
]
BALANCE_PERIODS = ["2024", "2025"]
BALANCE = [
    (0, "ASSETS", None, None),
    (1, "Current assets:", None, None),
    (2, "Cash and cash equivalents", 2900, 2136),
    (2, "Short-term investments", 362, 112),
    (2, "Receivables, net", 565, 679),
    (2, "Other current assets", 420, 349),
    (1, "Total current assets", 4247, 3276),
    (1, "Property and equipment, net", 578, 586),
    (1, "Goodwill", 5379, 5376),
    (1, "Acquisition-related intangibles, net", 400, 293),
    (1, "Deferred income taxes, net", 2380, 2420),
    (1, "Other assets", 436, 417),
    (0, "TOTAL ASSETS", 13420, 12368),
    (0, "LIABILITIES AND STOCKHOLDERS’ EQUITY", None, None),
    (1, "Current liabilities:", None, None),
    (2, "Accounts payable, accrued, and other current liabilities", 1276, 1359),
    (2, "Deferred net revenue (online-enabled games)", 1814, 1700),
    (2, "Senior notes, current, net", None, 400),
    (1, "Total current liabilities", 3090, 3459),
    (1, "Senior notes, net", 1882, 1484),
    (1, "Income tax obligations", 497, 594),
    (1, "Other liabilities", 438, 445),
    (0, "Total liabilities", 5907, 5982),
    (0, "Commitments and contingencies (See Note 14)", None, None),
    (1, "Stockholders’ equity:", None, None),
    (2, "Preferred stock, $0.01 par value. 10 shares authorized", None, None),
    (2, "Common stock, $0.01 par value. 1,000 shares authorized; 252 and 266 shares issued and outstanding, respectively", 3, 3),
    (2, "Additional paid-in capital", None, None),
    (2, "Retained earnings", 7582, 6470),
    (2, "Accumulated other comprehensive income (loss)", -72, -87),
    (1, "Total stockholders’ equity", 7513, 6386),
    (0, "TOTAL LIABILITIES AND STOCKHOLDERS’ EQUITY", 13420, 12368),
]
CASH_PERIODS = ["2023", "2024", "2025"]
CASH = [
    (0, "OPERATING ACTIVITIES", None, None, None),
    (1, "Net income", 802, 1273, 1121),
    (1, "Adjustments to reconcile net income to net cash provided by operating activities:", None, None, None),
    (2, "Depreciation, amortization, accretion and impairment", 536, 404, 356),
    (2, "Stock-based compensation", 548, 584, 642),
    (1, "Change in assets and liabilities:", None, None, None),
    (2, "Receivables, net", -34, 119, -115),
    (2, "Other assets", -103, 148, 40),
    (2, "Accounts payable, accrued, and other liabilities", 144, -208, 190),
    (2, "Deferred income taxes, net", -221, 82, -41),
    (2, "Deferred net revenue (online-enabled games)", -122, -87, -114),
    (1, "Net cash provided by operating activities", 1550, 2315, 2079),
    (0, "INVESTING ACTIVITIES", None, None, None),
    (1, "Capital expenditures", -207, -199, -221),
    (1, "Proceeds from maturities and sales of short-term investments", 395, 632, 695),
    (1, "Purchase of short-term investments", -405, -640, -437),
    (1, "Net cash provided by (used in) investing activities", -217, -207, 37),
    (0, "FINANCING ACTIVITIES", None, None, None),
    (1, "Proceeds from issuance of common stock", 80, 77, 78),
    (1, "Cash dividends paid", -210, -205, -199),
    (1, "Cash paid to taxing authorities for shares withheld from employees", -175, -196, -234),
    (1, "Common stock repurchases and excise taxes paid", -1295, -1300, -2508),
    (1, "Net cash used in financing activities", -1600, -1624, -2863),
    (0, "Effect of foreign exchange on cash and cash equivalents", -41, -8, -17),
    (0, "Increase (decrease) in cash and cash equivalents", -308, 476, -764),
    (0, "Beginning cash and cash equivalents", 2732, 2424, 2900),
    (0, "Ending cash and cash equivalents", 2424, 2900, 2136),
    (0, "Supplemental cash flow information:", None, None, None),
    (1, "Cash paid during the year for income taxes, net", -583, -300, -404),
    (1, "Cash paid during the year for interest", -56, -56, -56),
    (0, "Non-cash investing activities:", None, None, None),
    (1, "Change in accrued capital expenditures", -3, 25, None),
]

SCHEMA = "doc_id string, statement string, order_index int, level int, label string, col_ord int, period string, value double"


def demo_facts(spark: SparkSession) -> DataFrame:
    """The filing in long form: one row per line and period, empty cells included."""
    parts = (("income", INCOME_PERIODS, INCOME), ("balance", BALANCE_PERIODS, BALANCE), ("cash", CASH_PERIODS, CASH))
    rows = [
        ("demo", statement, i, level, label, k, period, None if v is None else float(v))
        for statement, periods, lines in parts
        for i, (level, label, *values) in enumerate(lines, 1)
        for k, (period, v) in enumerate(zip(periods, values, strict=True))
    ]
    return spark.createDataFrame(rows, SCHEMA)
