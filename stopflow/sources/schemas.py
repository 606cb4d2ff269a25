"""Explicit schemas of the data model."""

STOPS = "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type string, parent_station string"
ROUTES = ("agency_id string, route_id string, route_short_name string, route_long_name string, route_type string, route_desc string, "
          "route_url string, route_color string, route_text_color string")
TRIPS = "route_id string, trip_id string, service_id string, trip_headsign string, direction_id string, shape_id string"
STOP_TIMES = "trip_id string, stop_id string, arrival_time string, departure_time string, stop_sequence int"
SHAPES = "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double"
STATIC = {"stops": STOPS, "routes": ROUTES, "trips": TRIPS, "stop_times": STOP_TIMES, "shapes": SHAPES}

POSITION = ("tripId string, routeId string, lat double, lon double, heading double, nextStopId string, nextStopName string, eta string, "
            "headsign string, prevStopId string, prevTimeMs bigint, nextTimeMs bigint")
ARCHIVED_POSITION = POSITION + ", capturedAt bigint, feedGroupId string"
HOUR_PARTITIONS = "year string, month string, day string, hour string"

FEED_TIME = "struct<time: bigint, delay: int>"
FEED_ENTITY = (f"id string, tripUpdate struct<trip: struct<tripId: string, routeId: string, startDate: string>, vehicle: struct<id: string>, "
               f"timestamp: bigint, stopTimeUpdate: array<struct<stopId: string, stopName: string, arrival: {FEED_TIME}, departure: {FEED_TIME}, "
               "scheduleRelationship: string>>>")

TRANSLATIONS = "struct<translation: array<struct<text: string, language: string>>>"
ALERT_ENTITY = (f"id string, alert struct<active_period: array<struct<start: bigint, end: bigint>>, informed_entity: array<struct<agency_id: string, "
                f"route_id: string, stop_id: string>>, header_text: {TRANSLATIONS}, description_text: {TRANSLATIONS}>, "
                "`transit_realtime.mercury_alert` struct<alert_type: string, created_at: bigint, updated_at: bigint>")

METRIC = ("routeId string, direction string, timestamp bigint, trainCount int, avgDelaySeconds double, onTimePercent double, headwayAvgSeconds double, "
          "feedLatencyMs int, feedStatus string, expireAt bigint, feedGroupData string, alertCount int")
EVENT = ("pk string, timestamp bigint, tripId string, stationId string, stationName string, stopId string, delaySeconds int, alertId string, "
         "severity string, description string, expireAt bigint")
ROLLUP = ("routeId string, date string, direction string, avgDelay double, onTimePercent double, peakTrainCount int, totalAlerts int, avgHeadway double, "
          "medianHeadway double, totalBunching int, totalGaps int, totalSkippedStops int, totalTrips int")
METRIC_COLUMNS = [c.split()[0] for c in METRIC.split(", ")]
EVENT_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


def _fields(*schemas: str) -> str:
    """Struct body with the columns of the schemas, each once."""
    seen = {}
    for schema in schemas:
        for column in schema.split(", "):
            name, kind = column.split()
            seen.setdefault(name, kind)
    return ", ".join(f"{name}: {kind}" for name, kind in seen.items())


CHANGE = f"eventName string, image struct<{_fields(METRIC, EVENT)}>"

OUTAGE = ("station string, trainno string, equipment string, equipmenttype string, serving string, ADA string, outagedate string, "
          "estimatedreturntoservice string, reason string, isupcomingoutage string, ismaintenanceoutage string, borough string")
