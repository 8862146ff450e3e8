"""Word lists and source groups, as results depend on them."""

POSITIVE = ("beat", "beats", "surge", "surges", "jump", "jumps", "rally", "bullish", "upgrade", "growth", "record", "strong", "buy", "breakout", "higher", "gain", "gains")
NEGATIVE = ("miss", "misses", "fall", "falls", "drop", "drops", "lawsuit", "probe", "downgrade", "weak", "bearish", "sell", "lower", "loss", "cuts", "cut")
MARKET = (
    "stock", "stocks", "share", "shares", "earnings", "analyst", "analysts", "investor", "investors", "market", "markets", "nasdaq", "dow", "nyse",
    "revenue", "profit", "guidance", "valuation", "trading", "trader", "traders", "wall street",
)
CATALYST = (
    "acquire", "acquires", "acquired", "acquiring", "acquisition", "merger", "merges", "merged", "buyout", "takeover", "divest", "divestiture",
    "spinoff", "spin-off", "bankruptcy", "delisting", "activist", "antitrust", "lawsuit", "settlement", "investigation", "recall", "breach",
)
IMPACT = (
    "surge", "surges", "surged", "soar", "soars", "plunge", "plunges", "plunged", "tumble", "tumbles", "sink", "sinks", "slump", "jump", "jumps",
    "jumped", "rally", "rallies", "crash", "crashes", "spike", "spikes", "drop", "drops", "dropped", "fall", "falls", "fell", "slide", "slides",
    "rise", "rises", "rose", "gain", "gains", "gained", "beat", "beats", "miss", "misses", "cut", "cuts", "raise", "raises", "raised", "hike",
    "hikes", "warn", "warns", "warned", "guidance", "earnings", "upgrade", "downgrade", "spook", "spooks", "spooked", "%",
)
CLASS_ACTION_TOPIC = ("class action", "lead plaintiff", "securities fraud", "securities litigation", "shareholder rights", "investor rights")
SOLICITATION = ("law firm", "counsel", "encourage", "encourages", "remind", "reminds", "urge", "urges", "notifies", "alert", "deadline", "losses", "recover", "on behalf of")
SOLICITATION_STEM = "investigat"  # and what follows it
SYNTHETIC_TITLES = ("social mentions on ApeWisdom", "Trending on StockTwits", "FINRA short volume")
AMBIGUOUS_TICKERS = ("AI", "ARM", "NET", "T", "F", "ON", "ARE", "CAN", "NOW", "A", "GO", "IT")
DEFENSIVE_SECTORS = ("Utilities", "Consumer Staples", "Real Estate")
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "day", "did", "do", "does", "for", "from", "get", "got", "had", "has",
    "have", "he", "her", "here", "him", "his", "how", "if", "in", "into", "is", "it", "its", "just", "may", "me", "more", "most", "much", "must",
    "my", "new", "no", "not", "now", "of", "off", "on", "one", "only", "or", "other", "our", "out", "over", "own", "per", "said", "same", "say",
    "says", "see", "set", "she", "so", "some", "than", "that", "the", "their", "them", "then", "there", "they", "this", "to", "too", "up", "us",
    "very", "was", "way", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your", "stock", "stocks",
    "shares", "share", "market", "markets", "today", "week", "year", "percent",
)

#: Capitals that are no ticker in any form.
TICKER_STOP_WORDS = (
    "CEO", "CFO", "IPO", "ETF", "ETFS", "SEC", "USA", "US", "USD", "EPS", "GDP", "AI", "API", "URL", "RSS", "FAQ", "THE", "AND", "FOR", "NEW", "OLD",
    "BUY", "SELL", "HOLD", "CALL", "PUT", "PUTS", "MOON", "YOLO", "ATH", "CPI", "FOMC", "FED", "NYSE", "NASDAQ",
)

#: Common English words: as bare capitals they are no ticker, and such tickers need a cashtag or a telling alias.
COMMON_WORDS = (
    "A", "ABOUT", "AFTER", "AGAIN", "AGO", "ALL", "ALSO", "AM", "AN", "ANY", "ARE", "AS", "AT", "BACK", "BE", "BEEN", "BEST", "BIG", "BUT", "BY",
    "CAN", "CASH", "CLEAR", "COST", "COULD", "DAY", "DID", "DO", "DOES", "DOWN", "EACH", "EU", "EVEN", "EVER", "EVERY", "FAST", "FEW", "FIND", "FOR",
    "FREE", "FROM", "FUND", "GET", "GO", "GOOD", "GOT", "GREAT", "HAD", "HAS", "HAVE", "HE", "HELP", "HER", "HERE", "HIGH", "HIM", "HIS", "HOME",
    "HOPE", "HOUR", "HOW", "HUGE", "IF", "IN", "INTO", "IS", "IT", "ITS", "JUST", "KEEP", "KNOW", "LAST", "LESS", "LET", "LIFE", "LIKE", "LONG",
    "LOT", "LOVE", "LOW", "MADE", "MANY", "MAY", "ME", "MIND", "MORE", "MOST", "MUCH", "MUST", "MY", "NEED", "NET", "NEW", "NEXT", "NICE", "NO",
    "NONE", "NOR", "NOT", "NOW", "OF", "OFF", "OG", "ON", "ONCE", "ONE", "ONLY", "OPEN", "OR", "OTHER", "OUR", "OUT", "OVER", "OWN", "PART", "PAST",
    "PER", "PLAN", "PLAY", "RE", "REAL", "RIDE", "ROAD", "RUN", "S", "SAID", "SAME", "SAVE", "SAW", "SAY", "SEE", "SELF", "SET", "SHE", "SO", "SOME",
    "STILL", "SURE", "T", "TALK", "TH", "THAN", "THAT", "THE", "THEM", "THEN", "THERE", "THEY", "THIS", "TO", "TOO", "TOP", "TRUE", "TURN", "TWO",
    "UP", "US", "USE", "VERY", "WANT", "WAS", "WAY", "WE", "WELL", "WENT", "WERE", "WHAT", "WHEN", "WHERE", "WHICH", "WHILE", "WHO", "WHY", "WILL",
    "WISH", "WITH", "WOULD", "YET", "YOU", "YOUR",
)

#: Lead words of company names that are too general for an alias.
BRAND_STOP_WORDS = (
    "block", "open", "square", "beyond", "match", "unity", "carnival", "national", "general", "global", "american", "united", "first", "next", "core",
    "energy", "power", "capital", "financial", "holdings", "group", "trust", "fund", "growth", "value", "metals", "mining", "gold", "silver", "bank",
    "health", "medical", "digital", "data", "cloud", "systems", "solutions", "technologies", "industries", "international", "enterprise", "partners",
    "realty", "resources", "materials", "motors", "auto", "retail", "media", "five", "best", "good", "real", "world", "service", "services",
    "products", "brands", "company", "corporation",
)

#: Plaintiff firms, as patterns.
LAW_FIRMS = (
    "rosen law", "the rosen law firm", "pomerantz", "glancy prongay", "bronstein,? gewirtz", "levi & korsinsky", "kessler topaz", "robbins geller",
    "hagens berman", "bragar eagel", "kirby mcinerney", "faruqi & faruqi", "schall law", "kahn swick", "portnoy law", "gross law firm",
    r"howard g\.? smith", "johnson fistel", "block & leviton", "berger montague", "wolf haldenstein", "saxena white", r"scott\+scott", "grabar law",
)
EARNINGS = (
    "surge", "surges", "surged", "soar", "soars", "plunge", "plunges", "plunged", "tumble", "tumbles", "sink", "sinks", "slump", "jump", "jumps", "jumped",
    "rally", "rallies", "crash", "crashes", "spike", "spikes", "drop", "drops", "dropped", "fall", "falls", "fell", "slide", "slides", "rise", "rises",
    "rose", "gain", "gains", "gained", "beat", "beats", "miss", "misses", "cut", "cuts", "raise", "raises", "raised", "hike", "hikes", "warn", "warns",
    "warned", "guidance", "outlook", "earnings", "quarterly", "quarter", "eps", "revenue", "forecast",
)
NEWS_SOURCES = ("GDELT News", "Google News", "Bing News", "Yahoo Public News", "CNBC", "MarketWatch", "SEC Filings")
FRONT_NEWS_SOURCES = (*NEWS_SOURCES, "Press Releases", "Financial Media", "Nasdaq")
UNPAIRED_SOURCES = ("Price/Volume", "FINRA Short Volume", "StockTwits")

#: The four forms of a ticker in text, with their confidence; the last one is bare capitals.
TICKER_FORMS = (
    (r"\$([A-Z][A-Z0-9]{0,4})(?![A-Z0-9])", 3.0),
    (r"(?<![A-Za-z0-9_])ticker[:\s]+([A-Z][A-Z0-9]{0,4})(?![A-Za-z0-9_])", 2.6),
    (r"\(([A-Z][A-Z0-9]{1,4})\)", 2.4),
    (r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9]{1,4})(?![A-Za-z0-9_])", 1.0),
)

#: Words that say nothing about a company's name, and what a one-line description says of companies and of other things.
COMPANY_STOP_WORDS = (
    "the", "inc", "incorporated", "corp", "corporation", "company", "co", "ltd", "limited", "plc", "llc", "lp", "sa", "ag", "nv", "holdings", "holding",
    "group", "class", "common", "stock", "ordinary", "shares", "share", "new", "ny",
)
COMPANY_KINDS = (
    "compan", "corporation", "incorporated", "firm", "manufactur", "supplier", "retailer", "bank", "insurer", "insurance", "conglomerate", "enterprise",
    "fund", "etf", "exchange-traded", "trust", "fintech", "biotech", "pharmaceutical", "technolog", "software", "semiconductor", "airline", "automaker",
    "provider", "operator", "holding",
)
OTHER_KINDS = (
    "city", "town", "village", "township", "municipality", "county", "borough", "hamlet", "district", "region", "province", "island", "river", "lake",
    "mountain", "peak", "ocean", "sea", "desert", "valley", "park", "species", "genus", "plant", "animal", "bird", "fish", "insect", "dinosaur", "mineral",
    "apparatus", "instrument", "arena", "stadium", "venue", "amphitheatre", "amphitheater", "skyscraper", "bridge", "castle", "palace", "church",
    "cathedral", "temple", "mosque", "film", "movie", "tv series", "web series", "miniseries", "sitcom", "album", "song", "single", "soundtrack",
    "music group", "musical group", "girl group", "boy group", "vocal group", "rock band", "pop band", "band", "novel", "magazine", "newspaper",
    "video game", "comic", "character", "deity", "goddess", "mytholog", "saint", "emperor", "princess", "footballer", "cricketer", "actor", "actress",
    "singer", "rapper", "musician", "composer", "painter", "poet", "politician", "senator", "philosopher", "given name", "surname", "family name",
    "language", "dialect", "battle", "treaty", "university", "college", "polytechnic", "academy", "degree mill", "lawsuit", "antitrust", "court case",
    "legal case",
)

#: The texts on what moves a ticker, with their gaps.
TREND_TEXT = {
    "quiet": "Under-the-radar: volume running {volume}× normal{price} — crowd attention hasn't arrived yet, making this an early-mover signal.",
    "quiet_price": " with price up {move}%",
    "move": "{strong}{move}% price move",
    "strong": "strong ",
    "volume": "{volume}× normal volume",
    "social": "{n} social {word}",
    "mention": "mention",
    "news": "{n} news {word}",
    "hit": "hit",
    "platforms": "{n} data platforms",
    "by_social": "Retail",
    "by_news": "News",
    "by_price": "Price/volume",
    "by_many": "Multi-source",
    "joint": " · ",
    "composite": "Composite signal: {score}/100 across {n} data {word} — no single dominant catalyst yet.",
    "source": "source",
}

#: Large companies and a fund that are always covered, with their names.
MAJORS = {
    "SPY": "SPDR S&P 500 ETF Trust",
    "AAPL": "Apple Inc.",
    "MSFT": "Microsoft Corp.",
    "NVDA": "NVIDIA Corp.",
    "AMZN": "Amazon.com Inc.",
    "GOOGL": "Alphabet Inc.",
    "META": "Meta Platforms Inc.",
    "TSLA": "Tesla Inc.",
    "AVGO": "Broadcom Inc.",
    "AMD": "Advanced Micro Devices Inc.",
    "NFLX": "Netflix Inc.",
    "INTC": "Intel Corp.",
    "MU": "Micron Technology Inc.",
    "QCOM": "Qualcomm Inc.",
    "ORCL": "Oracle Corp.",
    "CRM": "Salesforce Inc.",
    "ADBE": "Adobe Inc.",
    "PLTR": "Palantir Technologies Inc.",
    "SMCI": "Super Micro Computer Inc.",
    "COIN": "Coinbase Global Inc.",
    "MSTR": "MicroStrategy Inc.",
    "JPM": "JPMorgan Chase & Co.",
    "BAC": "Bank of America Corp.",
    "GS": "Goldman Sachs Group Inc.",
    "WFC": "Wells Fargo & Co.",
    "V": "Visa Inc.",
    "MA": "Mastercard Inc.",
    "XOM": "Exxon Mobil Corp.",
    "CVX": "Chevron Corp.",
    "BA": "Boeing Co.",
    "DIS": "Walt Disney Co.",
    "WMT": "Walmart Inc.",
    "COST": "Costco Wholesale Corp.",
    "NKE": "Nike Inc.",
    "SBUX": "Starbucks Corp.",
    "MCD": "McDonald's Corp.",
    "KO": "Coca-Cola Co.",
    "PEP": "PepsiCo Inc.",
    "PFE": "Pfizer Inc.",
    "LLY": "Eli Lilly & Co.",
    "UNH": "UnitedHealth Group Inc.",
    "GM": "General Motors Co.",
    "UBER": "Uber Technologies Inc.",
    "ABNB": "Airbnb Inc.",
    "PYPL": "PayPal Holdings Inc.",
    "SHOP": "Shopify Inc.",
}
