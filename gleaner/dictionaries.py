"""Word lists, codes and patterns that define the results of the extractors."""

from __future__ import annotations

# Theme codes and their phrases.
THEMES = {
    "ECON_INTEREST_RATE": ["interest rate", "repo rate", "reverse repo", "lending rate", "rate hike", "rate cut"],
    "ECON_INFLATION": ["inflation", "consumer price", "wholesale price", "cpi", "wpi", "price rise"],
    "ECON_MONETARY_POLICY": ["monetary policy", "policy rate", "liquidity", "open market operation", "crr", "slr"],
    "ECON_GROWTH": ["gdp", "economic growth", "gross domestic product", "industrial output"],
    "FIN_BANKING": ["bank", "banking", "lender", "deposit", "credit growth", "npa", "non-performing asset"],
    "FIN_MARKETS": ["stock market", "sensex", "nifty", "equity", "bourses", "share price", "bond yield"],
    "FIN_IPO": ["ipo", "initial public offering", "public issue", "listing gains"],
    "FIN_MERGER": ["merger", "acquisition", "takeover", "amalgamation", "stake sale", "buyout"],
    "REG_ENFORCEMENT": ["penalty", "fine", "enforcement", "show cause", "adjudication", "disgorgement", "debarred"],
    "REG_GUIDELINE": ["circular", "circulars", "guideline", "guidelines", "notification", "notifications", "master direction", "framework", "regulation", "regulations"],
    "FRAUD_FINANCIAL": ["fraud", "scam", "ponzi", "embezzlement", "misappropriation", "round-tripping"],
    "CRIME_MONEY_LAUNDERING": ["money laundering", "anti-money laundering", "aml", "terror financing", "pmla"],
    "INSOLVENCY": ["insolvency", "bankruptcy", "liquidation", "resolution plan", "ibc", "nclt"],
    "TAX": ["income tax", "gst", "goods and services tax", "tax evasion", "direct tax", "cbdt"],
    "CRYPTO": ["cryptocurrency", "bitcoin", "crypto", "virtual digital asset", "blockchain"],
    "CORP_GOVERNANCE": ["corporate governance", "board of directors", "insider trading", "related party"],
}

# Places with latitude, longitude, first-level region and country.
PLACES = [
    ("New Delhi", 28.6139, 77.2090, "Delhi", "IN"),
    ("Mumbai", 19.0760, 72.8777, "Maharashtra", "IN"),
    ("Bengaluru", 12.9716, 77.5946, "Karnataka", "IN"),
    ("Bangalore", 12.9716, 77.5946, "Karnataka", "IN"),
    ("Kolkata", 22.5726, 88.3639, "West Bengal", "IN"),
    ("Chennai", 13.0827, 80.2707, "Tamil Nadu", "IN"),
    ("Hyderabad", 17.3850, 78.4867, "Telangana", "IN"),
    ("Pune", 18.5204, 73.8567, "Maharashtra", "IN"),
    ("Ahmedabad", 23.0225, 72.5714, "Gujarat", "IN"),
    ("Surat", 21.1702, 72.8311, "Gujarat", "IN"),
    ("Jaipur", 26.9124, 75.7873, "Rajasthan", "IN"),
    ("Lucknow", 26.8467, 80.9462, "Uttar Pradesh", "IN"),
    ("Kanpur", 26.4499, 80.3319, "Uttar Pradesh", "IN"),
    ("Nagpur", 21.1458, 79.0882, "Maharashtra", "IN"),
    ("Indore", 22.7196, 75.8577, "Madhya Pradesh", "IN"),
    ("Bhopal", 23.2599, 77.4126, "Madhya Pradesh", "IN"),
    ("Patna", 25.5941, 85.1376, "Bihar", "IN"),
    ("Chandigarh", 30.7333, 76.7794, "Chandigarh", "IN"),
    ("Kochi", 9.9312, 76.2673, "Kerala", "IN"),
    ("Gurugram", 28.4595, 77.0266, "Haryana", "IN"),
    ("Gurgaon", 28.4595, 77.0266, "Haryana", "IN"),
    ("Noida", 28.5355, 77.3910, "Uttar Pradesh", "IN"),
    ("Maharashtra", 19.7515, 75.7139, "Maharashtra", "IN"),
    ("Gujarat", 22.2587, 71.1924, "Gujarat", "IN"),
    ("Karnataka", 15.3173, 75.7139, "Karnataka", "IN"),
    ("Tamil Nadu", 11.1271, 78.6569, "Tamil Nadu", "IN"),
    ("Kerala", 10.8505, 76.2711, "Kerala", "IN"),
    ("Telangana", 18.1124, 79.0193, "Telangana", "IN"),
    ("West Bengal", 22.9868, 87.8550, "West Bengal", "IN"),
    ("Uttar Pradesh", 26.8467, 80.9462, "Uttar Pradesh", "IN"),
    ("Rajasthan", 27.0238, 74.2179, "Rajasthan", "IN"),
    ("Punjab", 31.1471, 75.3412, "Punjab", "IN"),
    ("New York", 40.7128, -74.0060, "New York", "US"),
    ("London", 51.5074, -0.1278, "England", "GB"),
    ("Singapore", 1.3521, 103.8198, "Singapore", "SG"),
    ("Dubai", 25.2048, 55.2708, "Dubai", "AE"),
    ("Hong Kong", 22.3193, 114.1694, "Hong Kong", "HK"),
    ("Tokyo", 35.6762, 139.6503, "Tokyo", "JP"),
    ("Frankfurt", 50.1109, 8.6821, "Hesse", "DE"),
]

# Organisations by surface form.
ORGANISATIONS = [
    ("RBI", "Reserve Bank of India"),
    ("Reserve Bank of India", "Reserve Bank of India"),
    ("SEBI", "Securities and Exchange Board of India"),
    ("Securities and Exchange Board of India", "Securities and Exchange Board of India"),
    ("IRDAI", "Insurance Regulatory and Development Authority of India"),
    ("NSE", "National Stock Exchange"),
    ("National Stock Exchange", "National Stock Exchange"),
    ("BSE", "Bombay Stock Exchange"),
    ("Bombay Stock Exchange", "Bombay Stock Exchange"),
    ("NABARD", "National Bank for Agriculture and Rural Development"),
    ("SIDBI", "Small Industries Development Bank of India"),
    ("SBI", "State Bank of India"),
    ("State Bank of India", "State Bank of India"),
    ("HDFC Bank", "HDFC Bank"),
    ("ICICI Bank", "ICICI Bank"),
    ("Axis Bank", "Axis Bank"),
    ("Kotak Mahindra Bank", "Kotak Mahindra Bank"),
    ("Punjab National Bank", "Punjab National Bank"),
    ("Bank of Baroda", "Bank of Baroda"),
    ("LIC", "Life Insurance Corporation of India"),
    ("CCIL", "Clearing Corporation of India"),
    ("NPCI", "National Payments Corporation of India"),
]
ORGANISATION_SUFFIXES = "Ltd Limited Pvt Private Inc PLC Corp Corporation Company Industries Holdings Enterprises Technologies Motors Finance Financial Securities Insurance Bank".split()

# Lexicons of the tone panel.
POSITIVE = """gain gains gained rise rises rose rising growth grew grow profit profits profitable surplus boost boosts boosted upgrade
upgraded approve approved approval strong stronger strengthen recovery recover recovered expansion expand expanded rally rallied surge
surged improve improved improvement beat outperform record robust ease eased easing optimistic upbeat favourable favorable buoyant""".split()
NEGATIVE = """loss losses fall falls fell falling decline declined declines fraud penalty penalties default defaults defaulted ban banned crisis
slump slumped downgrade downgraded weak weaker weaken deficit probe fine fined plunge plunged crash crashed slowdown lawsuit scam
breach violation violations miss missed shortfall distress insolvent bankrupt downturn sluggish pessimistic bearish""".split()
ACTIVE = """announce announced launch launched impose imposed raise raised cut approve investigate investigated order ordered direct directed
issue issued file filed acquire acquired merge merged sign signed appoint appointed resign resigned ban fine penalise penalize seize
seized freeze froze""".split()
# The smaller lexicons of the quick tone.
QUICK_POSITIVE = """gain gains rise rises rose growth grew profit profits surplus boost boosts upgrade upgraded approve approved approval strong
strengthen recovery recover expansion expand rally surge surged improve improved beat outperform record robust ease eased""".split()
QUICK_NEGATIVE = """loss losses fall falls fell decline declined fraud penalty penalties default defaults ban banned crisis slump slumped
downgrade downgraded weak weaken deficit probe fine fined plunge plunged crash slowdown lawsuit scam breach violation miss""".split()

# Words after a number that are no countable noun; scale words; currencies.
NO_COUNT = "crore crores lakh lakhs lac lacs million billion trillion thousand percent per rs inr usd eur gbp".split()
SCALES = {"crore": 1e7, "cr": 1e7, "lakh": 1e5, "lac": 1e5, "thousand": 1e3, "million": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9, "trillion": 1e12, "tn": 1e12}
CURRENCIES = {"₹": "INR", "rs": "INR", "inr": "INR", "usd": "USD", "us$": "USD", "$": "USD", "eur": "EUR", "€": "EUR", "gbp": "GBP", "£": "GBP"}
AMOUNT = r"(?:(₹|rs\.?|inr|usd|us\$|\$|eur|€|gbp|£)\s*)?([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crores?|cr\b|lakhs?|lacs?|million|mn\b|billion|bn\b|trillion|tn\b|thousand)?"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# Query parameters that only track visitors, besides those that begin with utm_.
TRACKING = "fbclid gclid dclid gclsrc igshid mc_cid mc_eid ref ref_src referrer cmpid cmp ncid ito spm yclid _ga s_kwcid wt_mc".split()

# Patterns of document titles and the types that they decide, in order.
CENTRAL_BANK_TYPES = [
    (r"(auction under |auction held|Auction Result|Underwriting Auction|Auction of State|Auction of Government|Auction Results|Treasury Bills auction|Auctions Conducted on)", "market_action"),
    (r"(Variable Rate Reverse Repo|Variable Rate Repo)", "market_action"),
    (r"(Money Market Operations|Reserve Money for)", "market_action"),
    (r"(Sovereign Gold Bond \(SGB\) Scheme|Sovereign Gold Bonds,|Buyback of Government of India Dated Securities)", "market_action"),
    (r"(Launch[esing]* [of ]*[\w\s\d\(\)-]+ Survey|^Survey on )", "survey"),
    (r"(Rate of interest on Government of India|Lending and Deposit Rates of Scheduled Commercial Banks)", "market_action"),
    (r"Foreign Exchange Turnover Data:", "market_data"),
]
MARKET_REGULATOR_NOTICE = r"(Notice of Demand under Recovery Certificate|Notice of Demand for Recovery Certificate|Notices of Attachment dated|Notice of Demand dated|Public Notice For E-Auction|Warning letter issued to)"
MARKET_REGULATOR_ORDER = r"(Remittance Order for Recovery Certificate|General Remittance Order dated|Completion Order for Recovery Certificate|Completion of Recovery Certificate|Release Order for Recovery Certificate|SEBI Order for Compliance|Settlement Order in respect of|Recovery Proceedings under|Adjudication Order)"
MARKET_REGULATOR_PROSPECTUS = r"(Prospectus|Addendum to DRHP)"
MARKET_REGULATOR_FILINGS = r"(/filings/public-issues/|/filings/takeovers/|/filings/rights-issues/|/filings/invit-public-issues/)"
DEFAULT_TYPE = "regulatory-notification"

# What a new document of a regulator is classified by; each is "other" until something better is known.
CLASSIFICATION_KEYS = ["channel", "customer_type", "function", "market_type", "occupation", "product_type", "risk_type"]

# Columns of the daily price file, by header, with their types.
PRICE_COLUMNS = {
    "TradDt": ("trade_date", "string"), "BizDt": ("biz_date", "string"), "Sgmt": ("segment", "string"), "Src": ("src", "string"),
    "FinInstrmTp": ("fin_instrm_tp", "string"), "FinInstrmId": ("fin_instrm_id", "bigint"), "ISIN": ("isin", "string"), "TckrSymb": ("ticker_symbol", "string"),
    "SctySrs": ("security_series", "string"), "XpryDt": ("expiry_date", "string"), "FininstrmActlXpryDt": ("actual_expiry_date", "string"),
    "StrkPric": ("strike_price", "double"), "OptnTp": ("option_type", "string"), "FinInstrmNm": ("fin_instrm_name", "string"),
    "OpnPric": ("open_price", "double"), "HghPric": ("high_price", "double"), "LwPric": ("low_price", "double"), "ClsPric": ("close_price", "double"),
    "LastPric": ("last_price", "double"), "PrvsClsgPric": ("prev_close", "double"), "UndrlygPric": ("underlying_price", "double"),
    "SttlmPric": ("settlement_price", "double"), "OpnIntrst": ("open_interest", "double"), "ChngInOpnIntrst": ("chg_open_interest", "double"),
    "TtlTradgVol": ("total_volume", "double"), "TtlTrfVal": ("total_value", "double"), "TtlNbOfTxsExctd": ("total_trades", "bigint"),
    "SsnId": ("session_id", "string"), "NewBrdLotQty": ("lot_size", "bigint"),
}
LEGACY_PRICE_COLUMNS = {
    "TIMESTAMP": ("trade_date", "string"), "SYMBOL": ("ticker_symbol", "string"), "SERIES": ("security_series", "string"),
    "OPEN": ("open_price", "double"), "HIGH": ("high_price", "double"), "LOW": ("low_price", "double"), "CLOSE": ("close_price", "double"),
    "LAST": ("last_price", "double"), "PREVCLOSE": ("prev_close", "double"), "TOTTRDQTY": ("total_volume", "double"), "TOTTRDVAL": ("total_value", "double"),
}

# Words without weight in chunk similarity.
STOP_WORDS = """the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could should
may might shall can it its this that these those he she we they i you not""".split()

# Replacements for safe file names, in order.
FILE_NAME_REPLACEMENTS = [
    *((x, "") for x in (".html", ".htm", ".php", ".pdf", ".aspx", ".asp", ".jsp")), ("%20", "_"), ("%E2%82%B9", ""), ("&amp;", "_"), ("&nbsp;", "_"),
    ("/", ""), ("\\", ""), ("?", "_"), ("|", "_"), ("*", ""), (":", ""), ("=", "_"), ("+", "_"), ("'", ""), ("`", ""),
    *((x, "_") for x in (";", "&", "%", "@", "#", "!", "{", "}", "<", ">", " ")), *[("__", "_")] * 4,
]

# Where the exchange keeps its daily price files, before and from the day on which the layout changed.
PRICE_FILE_CHANGE = "2024-08-01"
PRICE_FILE_OLD = "https://nsearchives.nseindia.com/content/historical/EQUITIES/{year}/{MON}/cm{day}{MON}{year}bhav.csv.zip"
PRICE_FILE_NEW = "https://nsearchives.nseindia.com/content/cm/BhavCopy_NSE_CM_0_0_0_{year}{month}{day}_F_0000.csv.zip"

# Reference number, serial, date, addressees and salutation in the summary of a central bank's notification.
NOTIFICATION_SUMMARY = r"(RBI[/A-Z]+\d{4}-\d{2,4}/\d*)(.+\d{4}-\d{2,4}[ ]*)((January|February|March|April|May|June|July|August|September|October|November|December)[\d ]+,[\d ]+)(.+)(Madam|Madam[ ]*/[ ]*Dear Sir|Dear Sir/|Dear Sir /|Madam / Dear Sir|Madam / Sir|$)"
