"""Literal relations of the studies.  Fixed values."""

from __future__ import annotations

# Target, page.
DAILY_PAIRS = [("QQQ", "Nvidia"), ("SPY", "Federal_Reserve"), ("XLE", "Petroleum"), ("XLF", "JPMorgan_Chase"), ("XLK", "Apple_Inc."), ("GLD", "Gold")]

# Target, page, company (None: macro page).
PANEL_PAIRS = [
    ("QQQ", "Nvidia", "NVDA"), ("QQQ", "Apple_Inc.", "AAPL"), ("QQQ", "Microsoft", "MSFT"), ("QQQ", "Alphabet_Inc.", "GOOGL"), ("XLK", "Apple_Inc.", "AAPL"),
    ("XLK", "Microsoft", "MSFT"), ("XLK", "Nvidia", "NVDA"), ("XLF", "JPMorgan_Chase", "JPM"), ("XLF", "Bank_of_America", "BAC"), ("XLF", "Goldman_Sachs", "GS"),
    ("XLE", "ExxonMobil", "XOM"), ("XLE", "Chevron_Corporation", "CVX"), ("SPY", "Federal_Reserve", None), ("XLE", "Petroleum", None), ("GLD", "Gold", None),
]

# The first sample of single stocks.
STOCKS = [
    ("AAPL", "Apple_Inc."), ("MSFT", "Microsoft"), ("NVDA", "Nvidia"), ("GOOGL", "Alphabet_Inc."), ("JPM", "JPMorgan_Chase"), ("BAC", "Bank_of_America"), ("GS", "Goldman_Sachs"),
    ("XOM", "ExxonMobil"), ("CVX", "Chevron_Corporation"), ("WMT", "Walmart"), ("KO", "The_Coca-Cola_Company"), ("PFE", "Pfizer"), ("JNJ", "Johnson_&_Johnson"),
    ("DIS", "The_Walt_Disney_Company"), ("NFLX", "Netflix"), ("INTC", "Intel"), ("CSCO", "Cisco_Systems"), ("BA", "Boeing"), ("MCD", "McDonald's"), ("PEP", "PepsiCo"),
]

# Ordered candidates of the second sample.
CANDIDATES = [
    ("ORCL", "Oracle_Corporation"), ("V", "Visa_Inc."), ("LLY", "Eli_Lilly_and_Company"), ("MA", "Mastercard"), ("PG", "Procter_&_Gamble"), ("HD", "Home_Depot"), ("COST", "Costco"),
    ("ABBV", "AbbVie"), ("UNH", "UnitedHealth_Group"), ("MRK", "Merck_&_Co."), ("IBM", "IBM"), ("QCOM", "Qualcomm"), ("TXN", "Texas_Instruments"), ("CAT", "Caterpillar_Inc."),
    ("HON", "Honeywell"), ("LMT", "Lockheed_Martin"), ("AMGN", "Amgen"), ("SBUX", "Starbucks"), ("NKE", "Nike,_Inc."), ("VZ", "Verizon_Communications"), ("T", "AT&T"),
    ("CMCSA", "Comcast"), ("WFC", "Wells_Fargo"), ("C", "Citigroup"), ("MS", "Morgan_Stanley"), ("AXP", "American_Express"), ("LOW", "Lowe's"), ("UPS", "United_Parcel_Service"),
    ("ABT", "Abbott_Laboratories"), ("UNP", "Union_Pacific_Corporation"),
]

# Size, thresholds and dates of the registered replication.
SAMPLE_SIZE, ALPHA, MIN_EVENTS, MIN_RV_RATIO, MIN_SAMPLE, MAX_MISSING = 20, 0.05, 25, 1.5, 15, 0.05
EARLIEST_RUN = {"new": "2026-12-01", "original": "2027-07-01"}
EVENT_RANGE = {"new": (None, None), "original": ("2026-11-23", "2027-06-30")}
