"""HTML sources: theatre calendar, sports pages, ticketer, press room, venue cards, news listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.functions import gates
from wayfare.functions import vocabulary as V
from wayfare.functions.dates import date_range, day_end, day_start, end_after_start, relabelled_utc
from wayfare.functions.geo import POINT
from wayfare.functions.text import fold, looked_up, require, slug
from wayfare.operators.validate import ContractError
from wayfare.sources import markup
from wayfare.sources.captures import class_text, computed_once, ld_json, parsed

# ---- Fixed values: sources, addresses, places and codes. ----

THEATRE, THEATRE_URL, THEATRE_NAME, THEATRE_POINT = "gran-teatro-nacional", "https://granteatronacional.pe", "Gran Teatro Nacional", (-77.003169, -12.0866312)
THEATRE_MONTHS, THEATRE_DROPPED, THEATRE_DEFAULT = 3, ("montaje", "descanso"), "proximamente"
SPORTS, SPORTS_URL, SPORTS_LISTING = "futbolperuano", "https://www.futbolperuano.com", "/liga-1/"
SPORTS_MATCH = r"^/liga-1/.+-m(\d+)$"
SPORTS_STATES = {"EventScheduled": "scheduled", "EventCancelled": "cancelled"}
SPORTS_VENUES = (
    ("universitario-de-deportes", "Estadio Monumental", "Estadio Monumental", -76.9353339, -12.0556474),
    ("alianza-lima", "Estadio Alejandro Villanueva", "Estadio Alejandro Villanueva", -77.0229272, -12.0685041),
    ("sporting-cristal", "Estadio Alberto Gallardo", "Estadio Alberto Gallardo", -77.0450308, -12.0378485),
)
TICKETS = "joinnus"
TICKETS_TARGET = r"/events/(concerts|sports|futbol)/lima-[a-z0-9-]*?-?(\d+)$"
TICKETS_CATEGORIES = {"concerts": "concert", "sports": "sport", "futbol": "futbol"}
TICKETS_STATES = {
    "https://schema.org/EventScheduled": "scheduled",
    "https://schema.org/EventRescheduled": "scheduled",
    "https://schema.org/EventCancelled": "cancelled",
    "https://schema.org/EventPostponed": "cancelled",
}
TICKETS_VENUES = (("estadio nacional", -77.0338629, -12.0670682), ("arena peru", -76.9798119, -12.0860937))
PRESS, PRESS_ORIGIN = "lima-expresa", "https://prensa.limaexpresa.pe"
PRESS_LINK = r"^(?:https?:)?//prensa\.limaexpresa\.pe(/news/[^/?#]+\.html)$"
CARDS, CARDS_NAME, CARDS_ADDRESS = "costa-21", "Costa 21", "Costa Verde, altura bajada John Lennon, San Miguel"
CARDS_TICKET = r"(?i)^https://teleticket\.com\.pe/([a-z0-9-]+)$"
CARDS_CATEGORIES, CARDS_DEFAULT = {"concierto": "concert", "festival": "festival"}, "concert"


def _point(lng: float, lat: float) -> Column:
    return F.struct(F.lit(lng).alias("lng"), F.lit(lat).alias("lat"))


def _event(frame: DataFrame, **columns: Column) -> DataFrame:
    """The event row: columns that aren't given are null."""
    types = {"location": POINT}
    return frame.select(*[(columns[n] if n in columns else F.lit(None)).cast(types.get(n, "string")).alias(n) for n in schemas.column_names(schemas.SCRAPED_EVENT)])


def _first_or_fail(frame: DataFrame, message: str) -> None:
    if frame.isEmpty():
        raise ContractError(message)


# ---- Theatre calendar ----

CELLS = "url string, grid boolean, date string, time string, slug string, title string, category string"


def calendar_cells(url: str, html: str) -> list[dict]:
    """One row per event link in a dated cell; a page with a grid but no links gives one row that says so."""
    root = markup.parse(html)
    dated = lambda n: n.tag == "td" and "date-date" in n.attrs
    grid = root.find_all(dated)
    if not grid:
        raise ContractError("theatre: no calendar grid found")
    rows = []
    for link in root.find_all(lambda n: n.tag == "a" and n.attrs.get("href", "").startswith("/evento/")):
        cell, contents = link.closest(dated), link.closest(lambda n: n.has_class("contents"))
        if cell is None:
            continue
        inside = contents.children if contents else []
        clock = next((c.attrs.get("datetime") for c in inside if isinstance(c, markup.Node) and c.tag == "time"), None)
        kind = contents.find(lambda n: n.tag == "span" and n.attrs.get("class", "").startswith("cat-")) if contents else None
        category = re.sub("^cat-", "", kind.attrs["class"]).strip() if kind else THEATRE_DEFAULT
        if category in THEATRE_DROPPED:
            continue
        row = {"date": cell.attrs["date-date"], "time": clock, "slug": link.attrs["href"].removeprefix("/evento/"), "title": link.text().strip()}
        if not all(row.values()) or not (clock or "")[11:19]:
            raise ContractError(f"theatre: missing field in {row}")
        rows.append({"url": url, "grid": True, "category": category} | row)
    return rows


def theatre_events(pages: DataFrame) -> DataFrame:
    cells = parsed(pages, calendar_cells, CELLS)
    clock = F.substring("time", 12, 8)
    return _event(
        cells,
        sourceId=F.lit(THEATRE),
        externalId=F.concat("slug", F.lit(":"), "date", F.lit("T"), F.substring(clock, 1, 5)),
        title=F.col("title"),
        category=F.col("category"),
        state=F.lit("scheduled"),
        startAt=F.concat("date", F.lit("T"), clock, F.lit("-05:00")),
        venueName=F.lit(THEATRE_NAME),
        location=_point(*THEATRE_POINT),
        sourceUrl=F.concat(F.lit(f"{THEATRE_URL}/evento/"), "slug"),
        sourcePayload=F.to_json(F.struct("slug", F.col("time").alias("gtnRawCellDatetime"), "date")),
    )


def theatre_months(now: Column, count: int = THEATRE_MONTHS) -> tuple[Column, Column]:
    """Months to fetch as yyyyMM, from now's, and the instant their window ends."""
    first = F.trunc(F.to_date(now), "month")
    months = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.date_format(F.add_months(first, i), "yyyyMM"))
    return months, F.add_months(first, count).cast("timestamp")


# ---- Sports ----

LINKS = "url string, matches int, place int, href string"


def match_links(url: str, html: str) -> list[dict]:
    """Links of the listing's match boxes; one row without a link carries the number of boxes."""
    boxes = markup.parse(html).find_all(lambda n: n.tag == "div" and n.has_class("match"))
    links = [a.attrs["href"] for b in boxes for a in b.find_all(lambda n: n.tag == "a" and n.attrs.get("href", "").startswith(SPORTS_LISTING))]
    return [{"url": url, "matches": len(boxes), "place": -1}] + [{"url": url, "matches": len(boxes), "place": i, "href": h} for i, h in enumerate(links)]


def home_club(path: Column) -> Column:
    found = [F.when(path.startswith(f"{SPORTS_LISTING}{club}-vs-"), F.lit(club)) for club, *_ in SPORTS_VENUES]
    return F.coalesce(*found)


def _parseable() -> Column:
    return F.col("href").rlike(SPORTS_MATCH)


def _boxes() -> Column:
    return F.sum(F.when(F.col("place") == -1, F.col("matches")))


def _counted(boxes: int, matches: int) -> tuple[int, int]:
    if boxes and not matches:
        raise ContractError(f"sports: {boxes} matches but none parseable")
    return boxes, matches


def _home_matches(links: DataFrame) -> DataFrame:
    matches = links.filter(_parseable()).groupBy("href").agg(F.min("place").alias("place"))
    return matches.filter(home_club(F.col("href")).isNotNull()).select(F.col("href").alias("path"), "place")


def sports_listing(pages: DataFrame) -> tuple[int, int, DataFrame]:
    """Boxes, different match links, and the paths of home matches of the clubs we follow, in page order."""
    links = parsed(pages, match_links, LINKS)
    # Both counts in one job, so the pages are parsed once for them.
    found = links.agg(_boxes(), F.count_distinct(F.when(_parseable(), F.col("href")))).first()
    return *_counted(found[0] or 0, found[1]), _home_matches(links)


def sports_targets(pages: DataFrame) -> DataFrame:
    """The paths of ``sports_listing`` for a scan, which reads no counts: the listing holds once a match is found, so its pages aren't all parsed for that."""
    links = parsed(pages, match_links, LINKS)
    if links.filter(_parseable()).isEmpty():
        _counted(links.agg(_boxes()).first()[0] or 0, 0)
    return _home_matches(links)


_SPORTS_ITEM = "struct<`@type`:string,itemReviewed:struct<`@type`:string,name:string,description:string,startDate:string,endDate:string,location:string,eventStatus:string,competitor:array<struct<name:string>>>>"


def sports_events(pages: DataFrame) -> DataFrame:
    """Events of match pages: url is the match's path or address."""
    path = F.regexp_replace("url", f"^{re.escape(SPORTS_URL)}", "")
    blocks = F.transform(ld_json(F.col("body")), lambda b: F.from_json(b, _SPORTS_ITEM))
    review = F.try_element_at(F.filter(blocks, lambda b: b["@type"] == "Review"), F.lit(1))
    stadium = {c: s for c, s, *_ in SPORTS_VENUES}
    frame = pages.select(path.alias("path"), review.alias("review")).withColumn("club", home_club(F.col("path"))).withColumn("item", F.col("review.itemReviewed"))
    item = {n: F.col(f"item.{n}") for n in ("name", "description", "startDate", "endDate", "location", "eventStatus", "competitor")}
    expected = looked_up(F.col("club"), {c: part for c, _, part, *_ in SPORTS_VENUES})
    state = looked_up(item["eventStatus"], SPORTS_STATES)
    ok = (
        F.when(F.col("club").isNull() | ~F.col("path").rlike(SPORTS_MATCH), F.lit("not a match path of a club we follow"))
        .when(F.col("review").isNull(), F.lit("no Review block"))
        .when((F.coalesce(F.col("item.@type"), F.lit("")) != "SportsEvent") | (F.coalesce(F.length(item["description"]), F.lit(0)) == 0) | item["startDate"].isNull() | item["name"].isNull(), F.lit("not a SportsEvent"))
        .when(~F.coalesce(F.contains(item["location"], expected), F.lit(False)), F.concat(F.lit("venue cross-check failed: "), F.coalesce(item["location"], F.lit("none"))))
        .when(state.isNull(), F.concat(F.lit("unmapped eventStatus "), F.coalesce(item["eventStatus"], F.lit("none"))))
    )
    frame = frame.withColumn("fault", ok)
    location = F.coalesce(*[F.when(F.col("club") == c, _point(lng, lat)) for c, _, _, lng, lat in SPORTS_VENUES])
    venue = looked_up(F.col("club"), stadium)
    payload = F.to_json(F.struct("path", item["name"].alias("competition"), item["competitor"]["name"].alias("competitors"), item["location"].alias("jsonLdLocation"), item["eventStatus"].alias("eventStatus"), venue.alias("stadium")))
    return _event(
        frame,
        sourceId=F.lit(SPORTS),
        externalId=require(F.col("fault").isNull(), F.concat(F.lit("m"), F.regexp_extract("path", SPORTS_MATCH, 1)), F.concat(F.lit("sports: "), F.col("fault"), F.lit(" on "), F.col("path"))),
        title=item["description"],
        category=F.lit("futbol"),
        state=state,
        startAt=item["startDate"],
        endAt=item["endDate"],
        venueName=venue,
        location=location,
        sourceUrl=F.concat(F.lit(SPORTS_URL), "path"),
        sourcePayload=payload,
    )


# ---- Ticketer ----


def sitemap_targets(pages: DataFrame) -> DataFrame:
    """url, id and category of the sitemap's Lima events."""
    locs = pages.select(F.explode(F.regexp_extract_all("body", F.lit("<loc>([^<]+)</loc>"), F.lit(1))).alias("url"))
    _first_or_fail(locs, "tickets: sitemap without <loc> entries")
    return locs.filter(F.col("url").rlike(TICKETS_TARGET)).select("url", F.regexp_extract("url", TICKETS_TARGET, 2).alias("id"), F.regexp_extract("url", TICKETS_TARGET, 1).alias("category"))


_TICKET = "struct<`@type`:string,name:string,startDate:string,endDate:string,eventStatus:string,location:struct<name:string,address:struct<streetAddress:string>>>"


def ticket_venue(name: Column) -> Column:
    """The point of the first venue whose pattern the name has."""
    return F.coalesce(*[F.when(fold(name).rlike(pattern), _point(lng, lat)) for pattern, lng, lat in TICKETS_VENUES])


def ticket_events(pages: DataFrame) -> DataFrame:
    """pages: url, body and the sitemap's category. The last linked-data block that is a whole Event counts."""
    blocks = F.transform(ld_json(F.col("body")), lambda b: F.from_json(b, _TICKET))
    whole = F.filter(blocks, lambda b: (b["@type"] == "Event") & (F.length(b["name"]) > 0) & (F.length(b["startDate"]) > 0) & b["eventStatus"].isNotNull())
    frame = pages.select("url", "category", F.try_element_at(whole, F.lit(-1)).alias("ld"))
    state = looked_up(F.col("ld.eventStatus"), TICKETS_STATES)
    fault = (
        F.when(F.col("ld").isNull(), F.lit("no Event block"))
        .when(state.isNull(), F.concat(F.lit("unmapped eventStatus "), F.col("ld.eventStatus")))
        .when(~F.col("url").rlike(TICKETS_TARGET), F.lit("no event id in url"))
    )
    start, end = relabelled_utc(F.col("ld.startDate")), relabelled_utc(F.col("ld.endDate"))
    venue = F.nullif(F.col("ld.location.name"), F.lit(""))
    payload = F.to_json(F.struct(venue.alias("venue"), F.col("ld.location.address.streetAddress").alias("address"), F.col("ld.eventStatus").alias("eventStatus"), F.col("ld.startDate").alias("rawStartDate")), {"ignoreNullFields": "false"})
    return _event(
        frame,
        sourceId=F.lit(TICKETS),
        externalId=require(fault.isNull(), F.regexp_extract("url", TICKETS_TARGET, 2), F.concat(F.lit("tickets: "), fault, F.lit(" at "), F.col("url"))),
        title=F.col("ld.name"),
        category=looked_up(F.col("category"), TICKETS_CATEGORIES, F.col("category")),
        state=state,
        startAt=start,
        endAt=end_after_start(start, end),
        venueName=venue,
        location=ticket_venue(venue),
        sourceUrl=F.col("url"),
        sourcePayload=payload,
    )


# ---- Press room ----


def page_links(html: Column) -> Column:
    """href values of the page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def press_listing(pages: DataFrame) -> DataFrame:
    """Different paths of news with their places on the page."""
    links = pages.select(F.posexplode(page_links(F.col("body"))).alias("place", "href")).filter(F.col("href").rlike(PRESS_LINK))
    _first_or_fail(links, "press: listing without news links")
    return links.groupBy(F.regexp_extract("href", PRESS_LINK, 1).alias("path")).agg(F.min("place").alias("place"))


_ARTICLE = "struct<`@type`:string,headline:string,datePublished:string>"
_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def press_events(pages: DataFrame) -> DataFrame:
    """pages: path and body. Posts without a trigger are left out; those without a date in the text start when they were published."""
    blocks = F.transform(ld_json(F.col("body")), lambda b: F.from_json(b, _ARTICLE))
    whole = F.filter(blocks, lambda b: (b["@type"] == "NewsArticle") & (F.length(b["headline"]) > 0) & b["datePublished"].rlike(_WITH_OFFSET))
    frame = pages.select("path", F.try_element_at(whole, F.lit(-1)).alias("a"), F.trim(class_text(F.col("body"), "content-text"), F.lit(" \n\r\t")).alias("content"))
    fault = F.col("a").isNull() | (F.coalesce(F.length("content"), F.lit(0)) == 0)
    frame = frame.withColumn("text", require(~fault, F.concat(F.col("a.headline"), F.lit("\n"), F.col("content")), F.concat(F.lit("press: missing headline, date or body: "), F.col("path"))))
    frame = computed_once(frame, folded=fold(F.col("text")))
    frame = computed_once(frame, keywords=gates.distinct_matches(F.col("folded"), V.PRESS_TRIGGERS)).filter(F.size("keywords") > 0)
    published = F.substring(F.col("a.datePublished"), 1, 10).try_cast("date")
    frame = computed_once(frame, found=date_range(F.col("text"), published, F.col("folded")))
    payload = F.to_json(
        F.struct("path", F.col("a.datePublished").alias("datePublished"), F.col("keywords").alias("matchedKeywords"), F.col("found.raw").alias("matchedDate"), gates.arteries(F.col("folded")).alias("arteries")),
        {"ignoreNullFields": "false"},
    )
    return _event(
        frame,
        sourceId=F.lit(PRESS),
        externalId=F.regexp_replace(F.regexp_replace("path", "^/news/", ""), r"\.html$", ""),
        title=F.col("a.headline"),
        category=F.when(F.col("folded").rlike(rf"\b(?:{V.PRESS_CLOSURE})\b"), F.lit("road_closure")).otherwise(F.lit("road_work")),
        state=F.lit("scheduled"),
        startAt=F.coalesce(day_start(F.col("found.start")), F.col("a.datePublished")),
        endAt=day_end(F.col("found.end")),
        sourceUrl=F.concat(F.lit(PRESS_ORIGIN), "path"),
        dedupKey=slug(F.col("a.headline")),
        sourcePayload=payload,
    )


# ---- Venue cards ----

SHOWS = "url string, href string, slug string, title string, date string, category string"


def show_cards(url: str, html: str) -> list[dict]:
    rows = []
    for block in markup.parse(html).find_all(lambda n: n.has_class("news-block")):
        heading = block.find(lambda n: n.tag == "a" and n.closest(markup.tag("h4")) is not None)
        href, title = (heading.attrs.get("href", ""), heading.text().strip()) if heading else ("", "")
        ticket = re.match(CARDS_TICKET, href)
        info = [n.text().strip() for n in block.find_all(lambda n: n.tag == "li" and n.closest(lambda p: p.has_class("post-info")) is not None)]
        dates = [t for t in info if re.fullmatch(r"\d{2}-\d{2}-\d{4}", t)]
        if not ticket or not title:
            continue
        if not dates:
            raise ContractError(f'cards: "{title}" has no date')
        category = next((t for t in info if t not in dates), "").lower()
        rows.append({"url": url, "href": href, "slug": ticket[1], "title": title, "date": dates[0], "category": category})
    if not rows:
        raise ContractError("cards: page without show cards")
    return rows


def card_events(pages: DataFrame) -> DataFrame:
    from wayfare.functions.dates import dashed_date

    day = dashed_date(F.col("date"))
    return _event(
        parsed(pages, show_cards, SHOWS),
        sourceId=F.lit(CARDS),
        externalId=F.col("slug"),
        title=F.col("title"),
        category=looked_up(F.col("category"), CARDS_CATEGORIES, F.lit(CARDS_DEFAULT)),
        state=F.lit("scheduled"),
        startAt=require(day.isNotNull(), day_start(day), F.concat(F.lit("cards: invalid date "), F.col("date"))),
        venueName=F.lit(CARDS_NAME),
        sourceUrl=F.col("href"),
        sourcePayload=F.to_json(F.struct(F.lit(CARDS_NAME).alias("venue"), F.lit(CARDS_ADDRESS).alias("address"), F.col("category").alias("cardCategory"))),
    )


# ---- News listing as HTML ----

LISTED = "url string, id long, title string, description string, link string, datetime string"


def news_listing(pages: DataFrame, institution: str) -> DataFrame:
    """One row per headline link of the institution's listing page."""

    def rows(url: str, html: str) -> list[dict]:
        out = []
        wanted = f"/institucion/{institution}/noticias/"
        for a in markup.parse(html).find_all(lambda n: n.tag == "a" and wanted in n.attrs.get("href", "") and n.closest(markup.tag("h3")) is not None):
            href = a.attrs["href"]
            number = re.search(r"/noticias/(\d+)-", href)
            if not number:
                continue
            card = a.closest(lambda n: n.tag == "div" and n.has_class("p-6"))
            about = card.find_all(lambda n: n.attrs.get("id", "").endswith("-description")) if card else []
            at = card.find(lambda n: n.tag == "time" and "datetime" in n.attrs) if card else None
            link = href if href.startswith("http") else f"https://www.gob.pe{href}"
            out.append({"url": url, "id": int(number[1]), "title": a.text().strip(), "description": "".join(n.text() for n in about).strip(), "link": link, "datetime": at.attrs["datetime"] if at else ""})
        return out

    return parsed(pages, rows, LISTED)

