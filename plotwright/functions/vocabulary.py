"""Words that the readers of clauses know. All texts are folded first: lower case, no accents.

A phrase is words between spaces; a|b: either; w*: words that begin so; w?: may be absent; ~n: up to n words of any kind.
Everything below is fixed values.
"""

# Whose area a figure is: parts of an object or of its surroundings, plots, flats, buildings, the object's own surface.
PART = (
    "terraza|terrazas", "balcon*", "jardin*", "garaje*", "parking", "trastero|trasteros", "salon*", "cocina|cocinas", "dormitorio|dormitorios",
    "habitacion*", "bano|banos", "aseo|aseos", "patio|patios", "porche*", "solarium", "piscina|piscinas", "oficina|oficinas", "almacen*", "altillo*",
    "urbanizacion*", "zona|zonas comun*", "comunes", "edificabilidad", "edificable|edificables", "techo", "fachada|fachadas", "sotano*",
    "buhardilla*", "vestidor*", "lavadero*",
)
PLOT = ("parcela|parcelas", "terreno|terrenos", "solar|solares", "finca|fincas", "suelo|suelos", "plot", "land")
FLAT = ("piso*", "atico*", "apartamento|apartamentos", "duplex", "estudio|estudios", "loft|lofts", "flat", "apartment")
BUILT = (
    "superficie construida", "construid*", "util|utiles", "vivienda*", "edificado|edificada|edificados|edificadas", "habitable|habitables", "casa|casas",
    "chalet|chalets", "nave|naves", "local|locales", "villa|villas", "adosado|adosados", "pareado|pareados", "bungalow|bungalows", "built", "house", "home",
)
SURFACE = ("superficie|superficies",)
FLAT_TYPES = ("apartment", "flat", "piso", "studio", "duplex", "penthouse", "room", "loft")
# Nearest words that tell a plot from a building where parts don't matter.
PLOT_STEMS = ("parcela*", "terreno*", "solar*", "finca*", "suelo*", "plot*", "land*", "участ*", "земл*", "ділянк*")
BUILT_STEMS = ("construid*", "util*", "vivienda*", "edificad*", "habitable*", "built*", "living*", "house*", "home*", "chalet*", "casa*", "floor*", "дом*", "жил*")
# Units of area in square metres; loose ones count only beside an owner.
SQUARE = ("m 2", "m ^ 2", "mt|mts 2", "mt|mts . cuadrados", "mt|mts cuadrados", "metro|metros cuadrados", "sq . m", "sq m", "sqm", "м 2", "кв . м", "кв м")
HECTARE = ("hectarea|hectareas", "hectare|hectares", "ha|has", "га", "гектар*")
HUNDRED = ("сот*",)
LOOSE = ("mts", "mtrs", "mt", "metros")
OTHER_UNITS = ("km", "км", "sq")
# "at about 200 m from": a distance, not an area.
AT, ABOUT, FROM = "a", ("unos", "solo", "menos de", "mas de"), ("de", "del", "al", "hasta", "hacia")

CURRENCY = {"€": "EUR", "eur|euro|euros": "EUR", "$": "USD", "usd": "USD", "£": "GBP", "gbp": "GBP"}
AMOUNT_CURRENCY = ("€", "$", "£", "eur", "usd", "euro|euros", "евро", "долл*")
MAGNITUDE = {"k": 1e3, "тыс": 1e3, "thousand": 1e3, "mil": 1e3, "m": 1e6, "mm": 1e6, "mln": 1e6, "млн": 1e6, "million": 1e6, "millones": 1e6}
RANGE_MAGNITUDE = {"k": 1e3, "mil": 1e3, "тыс": 1e3, "m": 1e6, "mln": 1e6, "млн": 1e6, "million|millions": 1e6, "millones": 1e6}
UNREAD_MAGNITUDE = (
    "mm", "mio", "mn", "mrd", "bn", "b", "bill", "billion|billions", "billones", "millardo|millardos", "thousand|thousands", "lakh|lakhs", "crore|crores",
    "tn", "trillion|trillions",
)
TO = ("-", "–", "—", "to", "a", "hasta", "до")
RATE = (
    "/ h|hr|hora|horas|hour|dia|day|semana|week|mes|month|mo|час|день|мес", "per|a|an hour|day|week|month", "por hora|dia|semana|mes", "al dia|mes",
    "a la hora|semana", "в час|день|неделю|месяц", "hourly", "monthly", "mensual|mensuales",
)

AUCTION = ("subasta|subastas", "puja|pujas", "cesion|cesiones de|del remate", "auction|auctions")
AUCTION_NOT = ("sin", "ni")
AUCTION_NO = ("no es|son|hay|procede|proceden|viene|vienen", "no se trata de")
ARTICLES = ("de", "del", "un", "una", "la", "el")

SEASONAL = (
    "alquiler|alquileres|arrendamiento|arrendamientos|contrato|contratos de|por? corta? temporada|temporadas|temporal|temporales",
    "contrato|contratos de alquiler|arrendamiento de|por? corta? temporada|temporadas|temporal|temporales",
    "alquila|alquilan|alquilo|alquilamos ~4 por temporada|temporadas", "justificar la? temporalidad",
    "alquiler|alquileres|uso|estancia|estancias exclusiva|exclusivamente|exclusivo? vacacional|vacacionales", "uso exclusivo? de|para? vacaciones",
    "estancia|estancias corta|cortas", "corta|cortas estancia|estancias", "media estancia", "vacation rental|rentals", "holiday rental|rentals|let|lets",
    "seasonal rental|rentals|let|lets", "short -? term rental|rentals|let|lets|stay|stays", "temporary rental|rentals|let|lets|stay|stays",
    "временн*|сезонн*|посуточн*|краткосрочн* аренд*", "посуточн*", "аренд* только? для отдыха",
)
SEASONAL_MONTHS = ("por meses", "hasta|maximo|max .? de? 1|2|3|4|5|6|7|8|9|10|11 meses")
DEPOSIT = ("fianza|fianzas", "garantia|garantias", "deposito|depositos", "aval|avales", "pago|pagos", "deposit")
LONG_LET = ("larga|largas temporada|temporadas|duracion|estancia|estancias", "temporada|temporadas larga|largas", "o larga|largas", "long -? term")
NEAR_NOT = ("no", "sin", "nunca", "nada", "ni", "excepto", "salvo", "prohibido", "prohibida", "not", "never", "не", "без")
FAR_NOT = ("no", "sin", "ni", "nunca", "nada", "not", "never", "не", "без")
LINKS = (
    "es", "son", "sera", "un", "una", "el", "la", "los", "las", "se", "trata", "de", "del", "hay", "ofrece", "ofrecemos", "admite", "admiten", "aceptamos",
    "acepta", "aceptan", "permite", "permiten", "apto", "apta", "disponible", "hacemos", "para", "por", "is", "a", "an", "this", "it", "это", "для",
)
AFTER_NOT = ("prohibido", "prohibida", "prohibidos", "prohibidas", "no")
TERM_NOT = ("не", "ни", "нет", "без", "not", "no", "non", "sin", "ні")

RENT = (
    "se alquila", "en alquiler", "alquilo", "alquiler|alquileres", "arrendamiento", "for rent", "to let", "сдается", "сдам", "аренда", "оренда",
    "€ / mes", "€ al mes", "eur|euro|euros / mes", "/ month", "per month", "al mes",
)
SALE = ("se vende", "en venta", "vendo", "venta", "for sale", "продаж*", "продам", "продаю")

# What shows that a search hit is about a property: whole words with an optional plural ending, phrases, beginnings of words.
PROPERTY = (
    "piso", "casa", "chalet", "atico", "duplex", "estudio", "terreno", "parcela", "solar", "finca", "inmueble",
    "propiedad", "nave", "local", "villa", "flat", "apartment", "house", "home", "land", "plot", "condo", "bungalow",
    "townhouse", "loft", "room", "property", "propertie", "studio", "penthouse", "garage", "office", "warehouse",
    "oficina", "garaje", "parking", "aparcamiento", "trastero", "hotel", "masia", "edificio",
)
PROPERTY_PHRASES = ("obra nueva|nuevas", "bajo comercial|comerciales", "real estate|estates", "local|locales comercial|comerciales", "дом|дома|дому|доме|домом|домов|домы")
PROPERTY_STEMS = (
    "vivienda", "apartament", "habitaci", "oficin", "garaj", "edifici", "adosad", "inmobiliari", "hotel", "masia",
    "квартир", "будин", "комнат", "кімнат", "участ", "ділянк", "вилл", "нерухом", "недвижим", "гараж", "офис", "офіс",
    "помещени", "приміщ", "земл", "жиль", "житл", "пентхаус", "таунхаус", "котедж", "студи", "склад", "апартамент",
    "магазин", "коммерч", "сотк", "дача", "дачи",
)
SIGNAL_CURRENCY = ("€", "$", "£", "k €", "грн*", "uah*", "usd*", "eur", "euro|euros", "евро*", "євро*", "дол*")
SIGNAL_BEFORE = ("€", "$", "eur")
SIGNAL_UNITS = ("m 2", "m ^ 2", "м 2", "кв .? м*", "metro|metros", "mt|mts", "sq .? m*")
PAGE_CURRENCY, PAGE_BEFORE, PAGE_UNITS = ("€", "k €", "eur", "euro|euros"), ("€", "eur"), ("m 2", "m ^ 2", "metro|metros", "mt|mts")
ROOMS = ("hab*", "dorm*", "bed*", "room*", "комн*", "кімн*", "рум*", "ambientes")
COUNTS = ("uno", "una", "dos", "tres", "cuatro", "cinco", "one", "two", "three", "four", "five", "одна", "одну", "две", "два", "три", "четыре", "пять", "дві", "чотири")
COUNTED = ("hab*", "dorm*", "bedroom*", "bed", "комнат*", "кімнат*")
DEAL = (
    "venta", "vende|venden|vendemos", "vendo", "alquiler|alquileres", "alquila|alquilan|alquilamos", "alquilo", "comprar", "for sale", "for rent", "to let",
    "se vende", "se alquila", "продаж*", "продам*", "продаю*", "продаетс*", "оренд*", "аренд*", "сдам*", "сдаю*", "сдаетс*", "здам*", "здаю*",
)

# Planning zones: what stands before the number.
ZONE = ("nz", "n .? z .?", "norma zonal")
