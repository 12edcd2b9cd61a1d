"""Words, patterns and labels that decide what text means."""

from __future__ import annotations

# ---- Fixed values: the gates' vocabularies, over folded text unless said otherwise. ----

DISRUPTION_TRIGGERS = (
    r"cierres?|cierran?|cerrad[oa]s?|cerraran?|cortes?|cortan|desvios?|desvian?|desviaran?|interferencias?|restriccion(?:es)?|"
    r"restringid[oa]s?|restringen?|interrumpid[oa]s?|interrumpen?|suspension(?:es)?|suspendid[oa]s?|suspenden?|suspenderan?"
)
CLOSURE_PREFIXES = r"^(?:cierr|cerrad|cerrar|cort|desvi|interrump)"
ROAD_CONTEXT = (
    r"av(?:enida)?s?\.|avenidas?\b|jr\.|jiron(?:es)?\b|calles?\b|puentes?\b|ovalos?\b|carreteras?\b|autopistas?\b|malecon(?:es)?\b|paseos?\b|"
    r"transito\b|vehicular(?:es)?\b|peatonal(?:es)?\b|vias? expresas?\b|carril(?:es)?\b|tunel(?:es)?\b|paso a desnivel\b"
)
TRIGGER_CONTEXT_WINDOW = 150
# Over the text as it is, case and accents included.
ROAD_MENTION = r"(?:av(?:enida)?\.?|jr\.?|jir[oó]n|calle|puente|[oó]valo|malec[oó]n|carretera|autopista|paseo|t[uú]nel)\s+[A-ZÁÉÍÓÚÑ0-9][^,.;:()\n<]{2,40}"
ROAD_MENTIONS_KEPT = 5
LIMA_CONTEXT = (
    r"lima metropolitana|lima (?:norte|sur|este)|cercado de lima|callao|ventanilla|carmen de la legua|metropolitano\b|costa verde|javier prado|ramiro priale|"
    r"vias? expresas?|paseo de la republica|morales duarez|nestor gambetta|jorge chavez|huachipa|ancon|ate|barranco|brena|carabayllo|chaclacayo|chorrillos|"
    r"cieneguilla|el agustino|independencia|jesus maria|la molina|la victoria|lince|los olivos|lurigancho|chosica|lurin|magdalena del mar|miraflores|pachacamac|"
    r"pucusana|pueblo libre|puente piedra|punta hermosa|punta negra|rimac|san bartolo|san borja|san isidro|san juan de lurigancho|san juan de miraflores|"
    r"san martin de porres|san miguel\b|santa anita|santiago de surco|surquillo|villa el salvador|villa maria del triunfo|jiron de la union"
)
PRESS_TRIGGERS = r"cierres?|cerrad[oa]s?|desvios?|mantenimientos?|interrupcion(?:es)?|restriccion(?:es)?|cortes?|inhabilitad[oa]s?"
PRESS_CLOSURE = r"cierres?|cerrad[oa]s?|cortes?|desvios?|inhabilitad[oa]s?"
ARTERIES = (
    ("Vía de Evitamiento", "via de evitamiento"),
    ("Línea Amarilla", "linea amarilla"),
    ("Vía Expresa Paseo de la República", "via expresa|paseo de la republica"),
)
PAST_TENSE = (
    r"recuperamos|rehabilitamos|culminamos|concluimos|finalizamos|ejecutamos|realizamos|entregamos|inauguramos|reabrimos|restablecimos|"
    r"recupero|rehabilito|culmino|concluyo|finalizo|entrego|inauguro|reabrio|restablecio|"
    r"recuperaron|rehabilitaron|culminaron|concluyeron|finalizaron|entregaron|inauguraron|reabrieron|restablecieron|se realizo|se ejecuto|se reabrio|"
    r"fue (?:rehabilitad|recuperad|reabiert|entregad|culminad)[oa]|fueron (?:rehabilitad|recuperad|reabiert|entregad|culminad)[oa]s"
)
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8,
    "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
YEAR_ROLLS_AFTER_DAYS = 60

# ---- Fixed values: labels. ----

CATEGORY_LABELS = {
    "musica": "Música", "folclore": "Folclore", "danza": "Danza", "teatro": "Teatro", "montaje": "Montaje", "descanso": "Descanso",
    "proximamente": "Próximamente", "futbol": "Fútbol", "concert": "Concierto", "sport": "Deporte", "road_closure": "Cierre vial",
    "road_work": "Obra vial", "civil": "Evento cívico",
}
SOURCE_LABELS = {
    "gran-teatro-nacional": "Gran Teatro Nacional", "futbolperuano": "futbolperuano.com", "mml": "Municipalidad de Lima", "lima-expresa": "Lima Expresa",
    "recurring-events": "Eventos recurrentes", "gob-pe-atu": "ATU (gob.pe)", "gob-pe-sutran": "SUTRAN (gob.pe)", "gob-pe-mtc": "MTC (gob.pe)",
    "gob-pe-munilima": "Municipalidad de Lima (gob.pe)", "joinnus": "Joinnus", "costa-21": "Costa 21", "manual-curated": "Curado de fuentes oficiales",
}
STATE_LABELS = {"scheduled": "Programado"}
CANCELLED_LABEL = "Cancelado"
NO_LOCATION_LABEL = "Sin ubicación"
GATED_SOURCES = ("futbolperuano", "joinnus")
NATIONAL_INSTITUTIONS = ("sutran", "mtc")
INSTITUTIONS = ("atu", "sutran", "mtc", "munilima")

#: White space as web text has it: no-break and other spaces too.
SPACE = r"[\s   -     　﻿]"
