"""Fixed values of the domain: they must be as they are for right results."""

# The airport from which surfaces are drawn.
ORIGIN = (13.9133, 100.5957)

# The raster.
GRID = 60
LAT_LOW, LAT_HIGH = 13.45, 14.10
LNG_LOW, LNG_HIGH = 100.30, 100.90

# Speeds in km/h, radii in km, the side of a hash cell in degrees, the extra of a line change in km.
WALK_SPEED = 5.0
MODE_SPEED = {"rail": 35.0, "bus": 12.0, "boat": 15.0}
EARTH_KM = 6371.0
WALK_KM = 2.0
TRANSFER_KM = 0.5
PIER_KM = 0.3
CELL = 0.005
CONNECTION_KM = 0.3
DENSITY_DISCOUNT = 0.15

# Bands and their colours.
COST_BANDS = [15, 25, 35, 50, 75, 100, 150, 200, 300]
TIME_BANDS = [5, 10, 15, 20, 30, 45, 60, 90, 120]
COLORS = ["#1a9850", "#66bd63", "#a6d96a", "#d9ef8b", "#fee08b", "#fdae61", "#f46d43", "#d73027", "#a50026"]

# How much longer roads are than straight lines, by bearing from the origin in steps of 45 degrees.
CIRCUITY = [1.25, 1.35, 1.15, 1.30, 1.10, 1.50, 1.50, 1.35]

# Id, name, type, colour, base fare, formula, speed, tiers (up to km, fare or rate a km).
MODES = [
    ("bts", "BTS Skytrain", "rail", "#8BC34A", 17.0, "distance-based", 35.0, [(2, 17), (4, 20), (6, 24), (8, 28), (10, 32), (14, 37), (18, 42), (22, 48), (26, 55), (30, 62), (99, 65)]),
    ("mrt_blue", "MRT Blue Line", "rail", "#1565C0", 17.0, "distance-based", 35.0, [(2, 17), (4, 19), (6, 22), (8, 25), (10, 28), (14, 31), (18, 35), (22, 38), (26, 42), (30, 45), (99, 45)]),
    ("mrt_purple", "MRT Purple Line", "rail", "#7B1FA2", 14.0, "distance-based", 35.0, [(2, 14), (4, 17), (6, 20), (8, 23), (10, 26), (14, 30), (18, 34), (22, 38), (26, 42), (30, 42), (99, 42)]),
    ("arl", "Airport Rail Link", "rail", "#D32F2F", 15.0, "distance-based", 40.0, [(4, 15), (8, 20), (12, 25), (16, 30), (20, 35), (24, 40), (30, 45), (99, 45)]),
    ("bus_nonac", "Bus (Non-AC)", "bus", "#FF9800", 8.0, "flat", 12.0, [(99, 8)]),
    ("bus_ac", "Bus (AC)", "bus", "#FF5722", 13.0, "distance-based", 12.0, [(4, 13), (8, 15), (12, 17), (16, 19), (20, 21), (24, 23), (30, 26), (99, 26)]),
    ("chao_phraya", "Chao Phraya Express Boat", "boat", "#00BCD4", 15.0, "distance-based", 15.0, [(4, 15), (8, 18), (12, 21), (16, 24), (20, 27), (30, 30), (99, 30)]),
    ("khlong", "Khlong Saen Saep Boat", "boat", "#009688", 8.0, "distance-based", 15.0, [(4, 8), (8, 11), (12, 14), (16, 18), (20, 22), (30, 22), (99, 22)]),
    ("taxi", "Taxi (Metered)", "road", "#E91E63", 35.0, "metered", 11.0, [(2, 0), (10, 6.5), (20, 5.5), (99, 5.5)]),
    ("motorcycle", "Motorcycle Taxi", "road", "#795548", 25.0, "per-km", 20.0, [(2, 0), (99, 7)]),
    ("tuktuk", "Tuk-Tuk", "road", "#FFC107", 60.0, "per-km", 15.0, [(2, 0), (99, 18)]),
    ("grab_car", "Grab Car", "road", "#4CAF50", 45.0, "per-km", 11.0, [(2, 0), (99, 9)]),
    ("grab_bike", "Grab Bike", "road", "#00C853", 25.0, "per-km", 20.0, [(2, 0), (99, 7)]),
]

# Words that mark transit networks and operators, and kinds of stations.
NETWORK_WORDS = ["BTS", "MRT", "SRT", "ARL", "AIRPORT RAIL"]
OPERATOR_WORDS = ["BMCL", "BEM", "MRTA", "BTSC", "SRT", "ARL"]
STATION_KINDS = ["subway", "light_rail", "monorail"]
RAILWAY_KINDS = ["station", "halt", "stop"]
STATION_BOX = (13.5, 14.0, 100.3, 100.9)

# Patterns of station codes by line, and names that count without a code.
LINE_PATTERNS = {
    "blue": [r"^BL\d+$"],
    "purple": [r"^PP\d+$"],
    "pink": [r"^PK\d+$"],
    "yellow": [r"^YL\d+$"],
    "green_sukhumvit": [r"^N\d+$", r"^E\d+$", r"^CEN$"],
    "green_silom": [r"^S\d+$", r"^W\d+$", r"^CEN$"],
    "airport": [r"^A\d+$"],
    "red_north": [r"^RN\d+$", r"^กภ\.?$"],
    "red_west": [r"^RW\d+$", r"^ซอ\.?;?.*$", r"^บำ\.?;?.*$", r"^ตช\.?;?.*$"],
    "gold": [r"^G\d+$"],
}
LINE_HINTS = {
    "yellow": ["Lat Phrao", "Si Thepha"],
    "red_north": ["Don Mueang", "Krung Thep Aphiwat"],
    "gold": ["ICONSIAM", "Khlong San", "Charoen Nakhon"],
}
