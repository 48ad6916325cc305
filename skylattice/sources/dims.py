"""Reference dimensions: small fixed tables, of a size known here, so that joins may broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Callsign prefix and airline.
AIRLINES = [
    ("DLH", "Lufthansa"), ("RYR", "Ryanair"), ("BAW", "British Airways"), ("AFR", "Air France"), ("KLM", "KLM"), ("EZY", "easyJet"),
    ("WZZ", "Wizz Air"), ("VLG", "Vueling"), ("IBE", "Iberia"), ("SWR", "Swiss"), ("AUA", "Austrian Airlines"), ("SAS", "SAS"),
    ("FIN", "Finnair"), ("LOT", "LOT Polish Airlines"), ("TAP", "TAP Air Portugal"), ("THY", "Turkish Airlines"), ("AAL", "American Airlines"),
    ("UAL", "United Airlines"), ("DAL", "Delta Air Lines"), ("SWA", "Southwest Airlines"), ("JBU", "JetBlue"), ("ASA", "Alaska Airlines"),
    ("FDX", "FedEx Express"), ("UPS", "UPS Airlines"), ("ACA", "Air Canada"), ("QTR", "Qatar Airways"), ("UAE", "Emirates"),
    ("ETD", "Etihad Airways"), ("AIC", "Air India"), ("IGO", "IndiGo"), ("SEJ", "SpiceJet"), ("AXB", "Air India Express"),
    ("AKJ", "Akasa Air"), ("VTI", "Vistara"), ("GOW", "Go First"), ("LLR", "Alliance Air"),
]
#: Registration prefix and country.
REGISTRATIONS = [
    ("VT", "India"), ("N", "United States"), ("G", "United Kingdom"), ("D", "Germany"), ("F", "France"), ("HZ", "Saudi Arabia"),
    ("A6", "United Arab Emirates"), ("A7", "Qatar"), ("A4O", "Oman"), ("9V", "Singapore"), ("B", "China"), ("JA", "Japan"),
    ("HL", "South Korea"), ("9M", "Malaysia"), ("VH", "Australia"), ("S2", "Bangladesh"), ("AP", "Pakistan"), ("4R", "Sri Lanka"),
    ("9N", "Nepal"), ("A5", "Bhutan"), ("PK", "Indonesia"), ("SU", "Egypt"), ("TC", "Turkey"), ("EI", "Ireland"), ("PH", "Netherlands"),
    ("OE", "Austria"), ("HB", "Switzerland"), ("C", "Canada"), ("SE", "Sweden"), ("LN", "Norway"), ("OY", "Denmark"), ("OH", "Finland"),
    ("OO", "Belgium"), ("EC", "Spain"), ("I", "Italy"), ("CS", "Portugal"), ("OK", "Czech Republic"), ("SX", "Greece"), ("SP", "Poland"),
    ("HA", "Hungary"), ("9A", "Croatia"), ("YR", "Romania"), ("LZ", "Bulgaria"), ("TF", "Iceland"), ("LX", "Luxembourg"),
    ("OM", "Slovakia"), ("S5", "Slovenia"), ("YU", "Serbia"), ("UR", "Ukraine"), ("YL", "Latvia"), ("LY", "Lithuania"),
    ("ES", "Estonia"), ("9H", "Malta"), ("5B", "Cyprus"), ("4X", "Israel"),
]
#: Airport, country, latitude, longitude.
AIRPORTS = [
    ("LHR", "United Kingdom", 51.4700, -0.4543), ("CDG", "France", 49.0097, 2.5479), ("FRA", "Germany", 50.0379, 8.5622),
    ("AMS", "Netherlands", 52.3105, 4.7683), ("MAD", "Spain", 40.4983, -3.5676), ("FCO", "Italy", 41.8003, 12.2389),
    ("ZRH", "Switzerland", 47.4647, 8.5492), ("VIE", "Austria", 48.1103, 16.5697), ("CPH", "Denmark", 55.6180, 12.6560),
    ("ARN", "Sweden", 59.6519, 17.9186), ("WAW", "Poland", 52.1657, 20.9671), ("PRG", "Czechia", 50.1008, 14.2600),
    ("BRU", "Belgium", 50.9014, 4.4844), ("MUC", "Germany", 48.3538, 11.7861), ("BCN", "Spain", 41.2971, 2.0785),
    ("MXP", "Italy", 45.6306, 8.7281), ("OSL", "Norway", 60.1939, 11.1004), ("HEL", "Finland", 60.3172, 24.9633),
    ("DUB", "Ireland", 53.4213, -6.2701), ("LIS", "Portugal", 38.7813, -9.1359), ("JFK", "United States", 40.6413, -73.7781),
    ("LAX", "United States", 33.9416, -118.4085), ("ORD", "United States", 41.9742, -87.9073), ("ATL", "United States", 33.6407, -84.4277),
    ("DFW", "United States", 32.8998, -97.0403), ("DEN", "United States", 39.8561, -104.6737), ("SFO", "United States", 37.6213, -122.3790),
    ("SEA", "United States", 47.4502, -122.3088), ("MIA", "United States", 25.7959, -80.2870), ("BOS", "United States", 42.3656, -71.0096),
    ("IAH", "United States", 29.9902, -95.3368), ("PHX", "United States", 33.4352, -112.0101), ("LAS", "United States", 36.0840, -115.1537),
    ("MCO", "United States", 28.4312, -81.3081), ("EWR", "United States", 40.6895, -74.1745), ("MSP", "United States", 44.8848, -93.2223),
    ("DTW", "United States", 42.2124, -83.3534), ("PHL", "United States", 39.8744, -75.2424), ("SLC", "United States", 40.7899, -111.9791),
    ("IAD", "United States", 38.9531, -77.4565), ("DEL", "India", 28.5665, 77.1031), ("BOM", "India", 19.0896, 72.8656),
    ("BLR", "India", 13.1986, 77.7066), ("MAA", "India", 12.9941, 80.1709), ("HYD", "India", 17.2403, 78.4294),
    ("CCU", "India", 22.6520, 88.4463), ("AMD", "India", 23.0772, 72.6347), ("COK", "India", 10.1520, 76.4019),
    ("PNQ", "India", 18.5793, 73.9089), ("GOI", "India", 15.3808, 73.8314), ("JAI", "India", 26.8242, 75.8122),
    ("LKO", "India", 26.7606, 80.8893), ("TRV", "India", 8.4821, 76.9200), ("GAU", "India", 26.1061, 91.5859),
    ("NAG", "India", 21.0922, 79.0472), ("BBI", "India", 20.2444, 85.8178), ("IXC", "India", 30.6735, 76.7885),
    ("VNS", "India", 25.4524, 82.8593), ("PAT", "India", 25.5913, 85.0880), ("IDR", "India", 22.7218, 75.8011),
]


def airlines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AIRLINES, "prefix string, airline string")


def registrations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRATIONS, "prefix string, country string")


def airports(spark: SparkSession) -> DataFrame:
    """All pools together."""
    return spark.createDataFrame(AIRPORTS, "iata string, country string, airport_lat double, airport_lon double")


def values_sql(rows: list[tuple], name: str, columns: str) -> str:
    """A common table expression of a fixed table, for DuckDB."""
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"
