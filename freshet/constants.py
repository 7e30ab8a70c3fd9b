"""Fixed values of the data sources: codes, columns, limits and units."""

# Clock codes of the gauge service and their zones.
ZONE_BY_CODE = {
    "EST": "America/New_York", "EDT": "America/New_York",
    "CST": "America/Chicago", "CDT": "America/Chicago",
    "MST": "America/Denver", "MDT": "America/Denver",
    "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles",
}

# FIPS state codes and postal codes.
FIPS_STATES = {
    "01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "09": "CT",
    "10": "DE", "11": "DC", "12": "FL", "13": "GA", "15": "HI", "16": "ID", "17": "IL",
    "18": "IN", "19": "IA", "20": "KS", "21": "KY", "22": "LA", "23": "ME", "24": "MD",
    "25": "MA", "26": "MI", "27": "MN", "28": "MS", "29": "MO", "30": "MT", "31": "NE",
    "32": "NV", "33": "NH", "34": "NJ", "35": "NM", "36": "NY", "37": "NC", "38": "ND",
    "39": "OH", "40": "OK", "41": "OR", "42": "PA", "44": "RI", "45": "SC", "46": "SD",
    "47": "TN", "48": "TX", "49": "UT", "50": "VT", "51": "VA", "53": "WA", "54": "WV",
    "55": "WI", "56": "WY", "72": "PR",
}

# States with a seasonal snow pack.
SNOW_STATES = [
    "AK", "AZ", "CA", "CO", "CT", "IA", "ID", "IL", "IN", "KY", "MA", "MD", "ME", "MI", "MN",
    "MO", "MT", "ND", "NH", "NJ", "NM", "NV", "NY", "OH", "OR", "PA", "RI", "SD", "UT", "VA",
    "VT", "WA", "WI", "WV", "WY",
]

# Gauge parameter codes and their column names.
FLOW_PARAMETERS = {"00060": "cfs", "00065": "height", "00045": "precip_usgs"}

# Weather columns, split by how an hour of readings is folded.
WEATHER_SUMMED = ["p01m"]
WEATHER_AVERAGED = ["tmpf", "dwpf"]
WEATHER_FIRST_NUMERIC = [
    "ice_accretion_1hr", "mslp", "drct", "sped", "alti", "relh", "sknt", "feel", "vsby", "gust",
    "peak_wind_gust", "snowdepth",
]
WEATHER_FIRST_TEXT = ["skyc1"]

# Forcing variables and element sets.
FORCING_VARIABLES = [
    "shortwave_radiation", "longwave_radiation", "temperature", "specific_humidity",
    "precipitation", "potential_evaporation", "wind_east", "wind_north",
]
SNOW_ELEMENTS = ["WTEQ", "SNWD", "PREC", "TOBS"]
SOIL_DEPTHS_IN = [-2, -4, -8, -20, -40]

# File maturity of the daily 4 km snow product, most to least final.
SNOW_VARIANTS = ["stable", "provisional", "early"]

# Attributes shown beside an embedding, and their source columns.
EXPLORER_ATTRIBUTES = {
    "elev_m": "ELEV_MEAN_M_BASIN", "snow_pct": "SNOW_PCT_PRECIP",
    "drain_sqkm": "DRAIN_SQKM", "slope_pct": "SLOPE_PCT",
}

# Season starts (month, day) and slice order of a panel.
SEASON_STARTS = {"winter": (12, 1), "spring": (3, 1), "summer": (6, 1), "fall": (9, 1)}
PANEL_ORDER = ["winter", "spring", "summer", "fall", "flood", "drought"]
SLICE_HOURS = 92 * 24

# Physical constants and limits.
EARTH_RADIUS_KM = 6371.0
FEET_TO_M = 0.3048
INCHES_TO_MM = 25.4
SNOW_FILL = -9999
FORCING_FILL_MAX = -9990.0
SOIL_MAX_KM = 75.0
SNOTEL_MAX_KM = 330.0
FORCING_BEGIN = "1979-01-02"
SNOW_PRODUCT = "1034"

# Archive addresses used to name source files.
SNOW_ARCHIVE_URL = "https://noaadata.apps.nsidc.org/NOAA/G02158"
SNOW_4KM_URL = "https://climate.arizona.edu/data/UA_SWE"
SNOW_4KM_FINAL_URL = "https://daacdata.apps.nsidc.org/pub/DATASETS/nsidc0719_SWE_Snow_Depth_v1"
