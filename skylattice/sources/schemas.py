"""Explicit schemas; nothing on a stream is inferred."""

from __future__ import annotations

#: The canonical record.
STATE = """source string, icao24 string, callsign string, origin_country string, time_position long, last_contact long, longitude double,
  latitude double, baro_altitude double, on_ground boolean, velocity double, true_track double, vertical_rate double, geo_altitude double,
  squawk string, spi boolean, position_source int, ingest_ts string"""
#: The raw event log: the message as it came, and where and when from.
BRONZE = "raw_payload string, key string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, source_tag string"
#: Order of the positional snapshot.
POSITIONS = ["icao24", "callsign", "origin_country", "time_position", "last_contact", "longitude", "latitude", "baro_altitude", "on_ground", "velocity", "true_track", "vertical_rate", "sensors", "geo_altitude", "squawk", "spi", "position_source"]
#: Columns of the historical archive and their canonical names.
HISTORICAL = {"time": "time_position", "icao24": "icao24", "lat": "latitude", "lon": "longitude", "velocity": "velocity", "heading": "true_track", "vertrate": "vertical_rate", "callsign": "callsign", "onground": "on_ground", "spi": "spi", "squawk": "squawk", "baroaltitude": "baro_altitude", "geoaltitude": "geo_altitude", "lastcontact": "last_contact"}
