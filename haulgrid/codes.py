"""Code lists and column groups that results depend on."""

# Sector codes counted as freight related.
FREIGHT_CODES = (
    "11", "21", "22", "23", "31", "32", "33", "31-33", "42", "44", "45", "44-45", "48", "49", "48-49", "72",
)

# The sector rows kept from the GDP table.
GDP_CODES = (
    "All", "Gov", "11", "21", "22", "23", "31-33", "42", "44-45", "48-49", "51", "52", "53", "54", "55", "56",
    "61", "62", "71", "72", "81",
)

# Ranged codes and the single code each is stored under.
RANGED_CODES = {"31-33": "31", "44-45": "44", "48-49": "48"}

# Sector of each job-count column CNS01, CNS02, … in order.
JOB_SECTORS = (
    "11", "21", "22", "23", "31", "42", "44", "48", "51", "52", "53", "54", "55", "56", "61", "62", "71", "72",
    "81", "92",
)
# Sectors added up to freight jobs and to goods-producing jobs.
FREIGHT_JOB_SECTORS = ("11", "21", "22", "23", "31", "42", "44", "48")
GOODS_JOB_SECTORS = ("11", "21", "23", "31")

# Crossing-code suffix to railroad name.
RAIL_OWNERS = (
    ("CEDR", "CN"), ("DME", "CPRS"), ("PGR", "PGR"), ("SOO", "CPRS"), ("UP", "UP"), ("CP", "CPRS"),
)

# Survey variables by table; a group is the sum of its members.
ACS_AGE65 = (
    "B01001_020", "B01001_021", "B01001_022", "B01001_023", "B01001_024", "B01001_025", "B01001_044", "B01001_045",
    "B01001_046", "B01001_047", "B01001_048", "B01001_049",
)
ACS_POV100 = (
    "B17026_002", "B17026_003", "B17026_004",
)
ACS_POV185 = (
    "B17026_002", "B17026_003", "B17026_004", "B17026_005", "B17026_006", "B17026_007", "B17026_008",
)
ACS_ENGLISH = (
    "B16004_003", "B16004_025", "B16004_047", "B16004_005", "B16004_010", "B16004_015", "B16004_020", "B16004_027",
    "B16004_032", "B16004_037", "B16004_042", "B16004_049", "B16004_054", "B16004_059", "B16004_064",
)
ACS_DISABLED = (
    "B18101_004", "B18101_007", "B18101_010", "B18101_013", "B18101_016", "B18101_019", "B18101_023", "B18101_026",
    "B18101_029", "B18101_032", "B18101_035", "B18101_038",
)
