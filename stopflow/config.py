"""Domain defaults. Every operator takes these as arguments; no logic reads them directly."""

LOCAL_ZONE = "America/New_York"

# Thresholds in seconds.
ON_TIME_SECONDS = 300
BUNCH_SECONDS = 120
GAP_SECONDS = 900
MAX_HEADWAY_SECONDS = 3600
STALE_TRIP_MINUTES = 30
TTL_DAYS = 90

# Express and shuttle aliases.
ROUTE_ALIASES = {"5X": "5", "6X": "6", "7X": "7", "FX": "F", "GS": "S", "FS": "S", "SIR": "SI"}

# Feed group of each route.
FEED_GROUPS = {
    "1234567": ["1", "2", "3", "4", "5", "6", "7", "S", "GS"],
    "ACE": ["A", "C", "E", "FS", "H"],
    "BDFM": ["B", "D", "F", "M"],
    "G": ["G"],
    "JZ": ["J", "Z"],
    "L": ["L"],
    "NQRW": ["N", "Q", "R", "W"],
    "SI": ["SI", "SIR"],
}

# Stop-id prefixes served by each route.
ROUTE_PREFIXES = [
    ("A", "A"), ("B", "D"), ("C", "A"), ("D", "D"), ("E", "E"), ("E", "F"), ("F", "F"), ("G", "G"),
    ("J", "J"), ("J", "M"), ("L", "L"), ("M", "M"), ("N", "N"), ("N", "R"), ("Q", "D"), ("Q", "Q"),
    ("Q", "R"), ("R", "R"), ("S", "H"), ("S", "S"), ("SI", "S"), ("W", "N"), ("W", "R"),
    ("Z", "J"), ("Z", "M"),
]

# Inclusive numeric stop-id ranges served by each route.
ROUTE_RANGES = [
    ("1", 101, 142), ("2", 201, 247), ("2", 301, 301), ("3", 301, 302), ("4", 401, 423),
    ("4", 621, 640), ("5", 201, 247), ("5", 401, 423), ("5", 501, 532), ("6", 601, 640),
    ("7", 701, 726), ("A", 101, 199), ("N", 1, 45), ("Q", 13, 45), ("R", 1, 45), ("W", 1, 27),
]

# Northbound and southbound terminal of each route.
ROUTE_TERMINALS = [
    ("1", "Van Cortlandt Park-242 St", "South Ferry"),
    ("2", "241 St", "Flatbush Av-Brooklyn College"),
    ("3", "Harlem-148 St", "New Lots Av"),
    ("4", "Woodlawn", "Crown Heights-Utica Av"),
    ("5", "Eastchester-Dyre Av", "Flatbush Av-Brooklyn College"),
    ("6", "Pelham Bay Park", "Brooklyn Bridge-City Hall"),
    ("6X", "Pelham Bay Park", "Brooklyn Bridge-City Hall"),
    ("7", "Flushing-Main St", "34 St-Hudson Yards"),
    ("7X", "Flushing-Main St", "34 St-Hudson Yards"),
    ("A", "Inwood-207 St", "Far Rockaway/Ozone Park"),
    ("B", "Bedford Park Blvd", "Brighton Beach"),
    ("C", "168 St", "Euclid Av"),
    ("D", "Norwood-205 St", "Coney Island-Stillwell Av"),
    ("E", "Jamaica Center", "World Trade Center"),
    ("F", "Jamaica-179 St", "Coney Island-Stillwell Av"),
    ("FS", "Franklin Av", "Prospect Park"),
    ("FX", "Jamaica-179 St", "Coney Island-Stillwell Av"),
    ("G", "Court Sq", "Church Av"),
    ("GS", "Times Sq-42 St", "Grand Central-42 St"),
    ("H", "Broad Channel", "Rockaway Park"),
    ("J", "Jamaica Center", "Broad St"),
    ("L", "8 Av", "Canarsie-Rockaway Pkwy"),
    ("M", "Forest Hills-71 Av", "Middle Village-Metropolitan Av"),
    ("N", "Astoria-Ditmars Blvd", "Coney Island-Stillwell Av"),
    ("Q", "96 St", "Coney Island-Stillwell Av"),
    ("R", "Forest Hills-71 Av", "Bay Ridge-95 St"),
    ("S", "Times Sq-42 St", "Grand Central-42 St"),
    ("SI", "St George", "Tottenville"),
    ("W", "Astoria-Ditmars Blvd", "Whitehall St"),
    ("Z", "Jamaica Center", "Broad St"),
]

# Alert speed factors by text found in the alert type.
ALERT_SPEED = [("suspension", 0.5), ("cancel", 0.5), ("delay", 0.8), ("service change", 0.9), ("detour", 0.9)]

SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}
