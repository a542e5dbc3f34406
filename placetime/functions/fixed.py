"""Word lists, thresholds and patterns that results depend on.

Everything here is data, listed in its natural order.  Operators import from here so a
value is stated once.
"""

# -- fixed values: time-of-day partitions (hours, inclusive start / exclusive end) ----------
DAY_START_HOUR = 6
NIGHT_START_HOUR = 20
GRANULAR_HOURS = {
    "morning": (6, 7, 8, 9, 10, 11),
    "afternoon": (12, 13, 14, 15, 16, 17),
    "evening": (18, 19, 20, 21),
    "night": (22, 23, 0, 1, 2, 3, 4, 5),
}

# -- fixed values: street and stop-name words that carry no identity ------------------------
STREET_SUFFIXES = (
    "st", "street", "ave", "avenue", "blvd", "boulevard", "dr", "drive", "ct", "court",
    "ln", "lane", "pl", "place", "ter", "terrace", "way", "hwy", "highway", "rd", "road",
    "plz", "plaza", "row", "aly", "alley", "cir", "circle",
)
STOP_NAME_WORDS = ("st", "ave", "blvd", "and", "the", "way")

# -- fixed values: free-text tokens of the signal predicates --------------------------------
DRUG_TOKENS = ("DRUG", "DEALER", "SALES", "METH")
DEALER_TOKENS = (
    "FOR SALE", "SALE", "SALES", "TRANSPORT", "FURNISH", "DELIV", "MANUFACTUR", "TRAFFIC",
    "CULTIVAT", "MAINTAIN PREMISE", "MONEY OFFENSE", "DRUG LAB APPARATUS",
)
SHELTER_TOKENS = ("TRANSIT_SHELTER", "TRANSIT SHELTER")
OVERFLOW_TOKENS = ("overflow",)
DUMPING_TOKENS = (
    "furniture", "mattress", "appliance", "refriger", "electronic", "tire",
    "illegal_dumping", "illegal dumping", "bulky",
)
HAZARD_TOKENS = (
    "human", "urine", "fece", "needle", "syringe", "oil", "hazard", "medical", "biohaz",
)

# -- fixed values: vehicle descriptions and their coarse type -------------------------------
VEHICLE_TYPES = {
    "Vehicle, Stolen, Auto": "auto",
    "Vehicle, Stolen, Truck": "truck",
    "Vehicle, Stolen, Motorcycle": "motorcycle",
    "Vehicle, Stolen, Other Vehicle": "other",
    "Vehicle, Stolen, Mobile Home or House Trailer": "other",
    "Vehicle, Stolen, Bus": "other",
}

# -- fixed values: labelled patterns for the basis of a listed stop -------------------------
BASIS_PATTERNS = (
    ("contractor", r"(?i)missed servicing"),
    ("cbd", r"(?i)\bCBD\b|Partnership|TNDC"),
    ("state", r"(?i)State of California|Highway Patrol|General Services"),
    ("mayor", r"(?i)Mayor"),
)

# -- fixed values: districts, id prefixes and record states ---------------------------------
DISTRICT_LABELS = {
    "NORTHERN": "Northern", "MISSION": "Mission", "CENTRAL": "Central",
    "TENDERLOIN": "Tenderloin", "SOUTHERN": "Southern", "BAYVIEW": "Bayview",
    "PARK": "Park", "RICHMOND": "Richmond", "INGLESIDE": "Ingleside", "TARAVAL": "Taraval",
}
ID_PREFIXES = {
    "Central": "CEN", "Northern": "NOR", "Mission": "MIS", "Tenderloin": "TEN", "Other": "OTH",
}
RECORD_STATES = ("open_in_progress", "closed_completed", "at_risk_on_hold")
TEXT_LIMITS = {
    "description": 5000, "evidence": 5000, "tactics": 2000, "owner": 200, "agencies": 500,
    "roadblock": 2000, "outcomes": 2000, "notes": 2000,
}
DISTRICT_THIRD_KPI = {     # signal, label, goal
    "Northern": ("fraud", "Fraud reports", "down"),
    "Central": ("dog_bites", "Dog bites", "down"),
    "Mission": ("street_robbery", "Street robbery", "down"),
    "Tenderloin": ("dog_bites", "Dog bites", "down"),
}
MOST_LEVERS, MOST_LINKS = 10, 20
KR_LABELS = {
    "drug": "Drug-related complaints",
    "overflow": "Overflowing trash cans",
    "dumping": "Illegal dumping",
    "hazard": "Health-hazard waste",
    "homeless_presence": "Homelessness presence",
}

VERDICT_LABELS = {
    "no_history": "Not enough history", "up_good": "Rising — good", "down_good": "Improving",
    "up_bad": "Falling short", "down_bad": "Worsening", "flat": "Little change",
}

# -- fixed values: thresholds ---------------------------------------------------------------
CELL_E5 = 100                 # 0.001 degree grid cell
CELL_FLOOR = 6                # least volume of a cell to be classified
TIDE_BAND = 0.35              # dead band around the district tide
BASELINE_SPAN = ("2023-01", "2024-12")
SPLIT_DATE = "2025-01-08"
NOW_MONTHS = 3
VERDICT_BAND = 0.05           # verdicts
TONE_BAND = 0.005             # chip tone
LOW_BASE = 20                 # least year-ago base of a fortnight figure
CLIFF_BAND = 0.40             # snapshot swing worth a look
STOP_RADIUS_M = 25
RING_RADIUS_M = 250
NEIGHBOUR_RADIUS_M = 400
SNAP_RADIUS_M = 100
SNAP_NAME_RADIUS_M = 160
NEARBY_M = 80
IMAGE_RADIUS_M = 40
LAG_CDF_DAYS = 120
SOLID_COMPLETENESS = 0.985
COHORT_MATURITY_DAYS = 180
COHORT_DAY_GRID = (0, 7, 14, 30, 45, 60, 90)
COHORT_MONTH_GRID = (0, 1, 2, 3)
CONFIDENCE_BAND = 0.05
CURVE_POINTS = (5, 10, 25, 50, 100, 200)
MISSING_GRID = (0, 3, 6, 9, 12, 15, 18, 21, 25, 30, 37)
METRES_PER_DEGREE = 111320
EARTH_RADIUS_M = 6371000
EDGE_EPSILON = 1e-12
E5 = 100000
E5_METRES = METRES_PER_DEGREE / E5
