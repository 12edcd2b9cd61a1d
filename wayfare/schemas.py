"""Schemas of what enters, moves through and leaves the engine, and the rows of reference data."""

from __future__ import annotations

POINT = "struct<lng:double,lat:double>"

#: A fetched page: kind is ok, http-4xx or transient; body is there only if ok.
CAPTURE = "url string, kind string, status int, body string"

#: A scraped event before it is stored. Instants are ISO strings with an offset; sourcePayload is JSON.
SCRAPED_EVENT = (
    f"sourceId string, externalId string, title string, startAt string, endAt string, location {POINT}, state string, category string, "
    "venueName string, sourcePayload string, sourceUrl string, dedupKey string"
)
QUARANTINED_POST = "sourceId string, externalId string, title string, url string, reason string, postDate string, detail string"

EVENTS = (
    f"id long, source_id string, external_id string, region_id long, title string, venue_name string, category string, state string, start_at timestamp, end_at timestamp, "
    f"location {POINT}, source_payload string, source_url string, dedup_key string, ingested_at timestamp, updated_at timestamp"
)
REGIONS = f"id long, country_code string, level int, parent_id long, slug string, name string, iso_code string, centroid {POINT}, timezone string"
INGEST_STATE = "source_id string, cursor string, last_run_at timestamp, last_success_at timestamp, last_error_at timestamp, last_error string, consecutive_failures int"
INGEST_QUARANTINE = (
    "id long, source_id string, external_id string, title string, url string, reason string, detail string, post_date timestamp, first_seen_at timestamp, last_seen_at timestamp"
)
ROAD_ALERTS = (
    f"id long, estado string, location {POINT}, codigo_via string, nombre_carretera string, afectacion string, evento string, motivo string, fuente string, ubigeo string, "
    "reported_at timestamp, event_started_on date, dataset_updated_at timestamp, fetched_at timestamp, source_payload string"
)

EVENT_STATES = ("scheduled", "cancelled")
ALERT_LEVELS = ("normal", "restringido", "interrumpido")
QUARANTINE_REASONS = ("no-trigger", "no-road-context", "no-date", "past-event", "non-lima")

# Peru's regions of the first level, with the points of their capitals. Lima comes first, the others by code.
PERU_REGIONS = (
    ("lima", "Lima", "PE-LIM", -77.0428, -12.0464),
    ("amazonas", "Amazonas", "PE-AMA", -77.8694, -6.2294),
    ("ancash", "Áncash", "PE-ANC", -77.5278, -9.5278),
    ("apurimac", "Apurímac", "PE-APU", -72.8814, -13.6378),
    ("arequipa", "Arequipa", "PE-ARE", -71.535, -16.3989),
    ("ayacucho", "Ayacucho", "PE-AYA", -74.2233, -13.1588),
    ("cajamarca", "Cajamarca", "PE-CAJ", -78.5128, -7.1611),
    ("callao", "Callao", "PE-CAL", -77.1181, -12.0566),
    ("cusco", "Cusco", "PE-CUS", -71.9675, -13.532),
    ("huancavelica", "Huancavelica", "PE-HUV", -74.9742, -12.7867),
    ("huanuco", "Huánuco", "PE-HUC", -76.2422, -9.9306),
    ("ica", "Ica", "PE-ICA", -75.7286, -14.0678),
    ("junin", "Junín", "PE-JUN", -75.2049, -12.0651),
    ("la-libertad", "La Libertad", "PE-LAL", -79.0288, -8.1116),
    ("lambayeque", "Lambayeque", "PE-LAM", -79.8408, -6.7711),
    ("loreto", "Loreto", "PE-LOR", -73.2538, -3.7491),
    ("madre-de-dios", "Madre de Dios", "PE-MDD", -69.1893, -12.5933),
    ("moquegua", "Moquegua", "PE-MOQ", -70.9352, -17.1949),
    ("pasco", "Pasco", "PE-PAS", -76.2566, -10.6878),
    ("piura", "Piura", "PE-PIU", -80.6328, -5.1945),
    ("puno", "Puno", "PE-PUN", -70.0219, -15.8402),
    ("san-martin", "San Martín", "PE-SAM", -76.9722, -6.0339),
    ("tacna", "Tacna", "PE-TAC", -70.2463, -18.0066),
    ("tumbes", "Tumbes", "PE-TUM", -80.4515, -3.566),
    ("ucayali", "Ucayali", "PE-UCA", -74.5539, -8.3791),
)
COUNTRY, TIMEZONE = "PE", "America/Lima"


def columns(ddl: str) -> list[tuple[str, str]]:
    """Top-level columns of a DDL string: name and type."""
    found, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[start:i].split(None, 1)
            found.append((name, kind.strip()))
            start = i + 1
    return found


def column_names(ddl: str) -> list[str]:
    return [name for name, _ in columns(ddl)]
