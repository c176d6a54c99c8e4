"""Fixed values that results depend on: word lists, patterns and tables, stated as text."""

# --- Fixed values: closed domains -------------------------------------------------------------------------------------
FACT_TYPES = ("financial_metric", "operational_metric", "forward_guidance", "strategic_claim", "causal_explanation", "risk_disclosure", "accounting_policy")
EVIDENCE_TYPES = (
    "specific_metric", "definition", "forward_looking_statement", "strategic_position", "cross_period_comparison", "causal_explanation",
    "temporal_evolution", "risk_disclosure", "accounting_policy", "contradiction_detection",
)
TIERS = ("simple", "standard", "complex")
DEGRADATION_LEVELS = ("NORMAL", "PARTIAL", "CLARIFICATION_REQUEST", "HARD_HALT")
CHANNEL_K = {"simple": 10, "standard": 15, "complex": 20}
FUSED_N = {"simple": 8, "standard": 12, "complex": 16}
SLOT_BUDGET = {"simple": 2, "standard": 4, "complex": 6}
LOOP_MAX = {"simple": 2, "standard": 3, "complex": 4}
HYPOTHESES = {"simple": 1, "standard": 2, "complex": 3}
STRATEGY_OF_FACT = {
    "financial_metric": "restated_value",
    "operational_metric": "revised_value",
    "forward_guidance": "guidance_vs_actual",
    "strategic_claim": "later_reversal",
    "causal_explanation": "alternative_cause",
    "risk_disclosure": "materialization",
    "accounting_policy": "policy_change",
}
NUMERIC_SLOT_TYPES = ("specific_metric", "cross_period_comparison")
NARRATIVE_SLOT_TYPES = ("strategic_position", "causal_explanation", "temporal_evolution", "risk_disclosure", "accounting_policy", "contradiction_detection")
GAAP_FILTERED_TYPES = ("strategic_claim", "operational_metric", "causal_explanation", "risk_disclosure")

# --- Fixed values: numbers ---------------------------------------------------------------------------------------------
RRF_K = 60
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
CHUNK_WORDS, CHUNK_OVERLAP = 500, 50
STALL_DELTA = 0.03
STRONG_CONFIDENCE, PROSE_CONFIDENCE = 0.80, 0.5
MAX_TOKENS, TOKENS_PER_WORD = 2000, 1.3
FIRST_YEAR, LAST_YEAR = 2016, 2026
RELEASE_DAY = 18

# --- Fixed values: sections that are not chunked, and items of reports that are kept, with the part that each is in -------
SKIPPED_SECTIONS = (
    "consolidated_balance_sheets",
    "consolidated_statements_of_operations",
    "consolidated_statements_of_cash_flows",
    "consolidated_statements_of_comprehensive_income",
    "consolidated_statements_of_stockholders_equity",
    "cover_page",
    "signatures",
    "exhibits_index",
)
RETAINED_ITEMS = {
    "10-K": {"Item 1": "Part I", "Item 1A": "Part I", "Item 7": "Part II", "Item 7A": "Part II"},
    "10-Q": {"Item 2": "Part I", "Item 3": "Part I", "Item 1A": "Part II"},
}
RESULTS_ITEM = "2.02"

# --- Fixed values: sentence and chunk rules ----------------------------------------------------------------------------
ABBREVIATIONS = ("Inc", "Co", "Corp", "Ltd", "Mr", "Mrs", "Ms", "Dr", "Jr", "Sr", "St", "vs", "etc", "i.e", "e.g", "U.S", "U.K", "p.m", "a.m", "No", "Cf", "Ave")
LETTER_APPENDIX = (
    "Consolidated Statements of Operations",
    "Consolidated Balance Sheet",
    "Consolidated Statements of Cash Flows",
    "Reconciliation of Free Cash Flow",
    "Reconciliation of Non-GAAP",
)
TRANSCRIPT_FOOTERS = (
    r"(?im)^NETFLIX,\s*INC\.\s+FQ\d.*EARNINGS\s+CALL.*$",
    r"(?im)^Copyright\s*(\(c\)|©)?\s*\d{4}\s+S&P\s+Global.*$",
    r"(?m)^spglobal\.com/marketintelligence\s*\d*\s*$",
)

# --- Fixed values: characters and references that normalisation replaces --------------------------------------------------
PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#160;": " "}

# --- Fixed values: patterns ---------------------------------------------------------------------------------------------
TOKEN = r"\b[a-z0-9][a-z0-9'-]*\b"
NUMBER = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d+\.\d+\b|\b\d{2,}\b"
KEY_TERM = r"[A-Za-z][A-Za-z0-9'\-]{2,}"
GAAP_KEYWORDS = (
    r"\b(free cash flow|net income|operating income|operating margin|gross margin|streaming revenues?|cost of revenues?|earnings per share"
    r"|diluted (?:eps|earnings per share|shares?)|interest expense|income tax provision|provision for income tax(?:es)?)\b"
)
NUMERIC_FIGURE = r"(?:\$\s*[\d,.]+(?:\s*(?:billion|million|thousand|bn|mn|B|M|K))?|\b\d+(?:\.\d+)?\s*%)"
CORPORATE_ACTION = r"\b(share repurchase authorization|repurchase authorization)\b"
METRIC_PHRASES = (
    r"\b(?:operating\s+income(?:\s*\(loss\))?|operating\s+margin|net\s+income(?:\s*\(loss\))?|revenues?|gross\s+profit|free\s+cash\s+flow|operating\s+cash\s+flow"
    r"|net\s+cash\s+provided\s+by\s+operating|net\s+cash\s+provided\s+by\s+(?:used\s+in\s+)?investing|net\s+cash\s+provided\s+by\s+(?:used\s+in\s+)?financing"
    r"|cash\s+and\s+cash\s+equivalents|earnings\s+per\s+share|EPS|paid\s+net\s+adds?|paid\s+net\s+additions?|paid\s+memberships?|paid\s+subscribers?"
    r"|content\s+amortization|content\s+assets|stockholders'?\s+equity|total\s+assets|total\s+liabilities|long[- ]term\s+debt|marketing\s+expense"
    r"|general\s+and\s+administrative|research\s+and\s+development|technology\s+and\s+development|interest\s+expense|income\s+tax(?:es)?)\b"
)
SHARED_PHRASES = (
    r"\b(?:paid\s+memberships?|paid\s+subscribers?|paid\s+net\s+adds?|paid\s+net\s+additions?|operating\s+income|operating\s+margin|net\s+income|revenues?"
    r"|gross\s+profit|free\s+cash\s+flow|content\s+amortization|content\s+assets|stockholders'?\s+equity)\b"
)
INJECTIONS = (
    r"\bignore\s+(?:the\s+|all\s+|your\s+|any\s+)?(?:previous|prior|above|preceding)\s+(?:instructions?|prompts?|messages?|rules?)",
    r"\bdisregard\s+(?:the\s+|all\s+|your\s+|any\s+)?(?:previous|prior|above|preceding)\s+(?:instructions?|prompts?|messages?|rules?)",
    r"\breveal\s+(?:your\s+|the\s+)?(?:system\s+)?(?:prompt|instructions?)",
    r"\bshow\s+(?:me\s+)?(?:your\s+|the\s+)?(?:system\s+)?(?:prompt|instructions?)",
    r"\bwhat\s+(?:are|is)\s+your\s+(?:system\s+)?(?:prompt|instructions?)",
    r"\byou\s+are\s+now\s+",
    r"\bfrom\s+now\s+on\s*,?\s+you\s+",
    r"\bforget\s+(?:everything|all|your\s+(?:previous|prior))",
    r"\bact\s+as\s+(?:a\s+|an\s+)?(?:different|new|other)",
    r"\bpretend\s+(?:you\s+are|to\s+be)\s+",
    r"<\s*\|?\s*(?:system|im_start|im_end|endoftext)\s*\|?\s*>",
)
COMPETITORS = (
    r"\b(?:Disney(?:\+)?|Hulu|HBO(?:\s*Max)?|Max\b|Amazon\s+Prime|Prime\s+Video|Apple\s+TV(?:\+)?|Paramount(?:\+)?|Peacock|YouTube\s+TV|Spotify|Roku"
    r"|Tubi|Pluto\s*TV|Comcast|AT&T)\b"
)
COMPANY = r"\bnetflix\b"
EVOLUTION = r"\b(?:evolve|evolved|evolves|evolution|trajectory|over\s+time|shift(?:ed|ing)?|transition(?:ed|ing|s)?|change[ds]?\s+over|trend(?:ed|ing|s)?)\b"
COMPARISON = r"\b(?:compare[ds]?|comparison|versus|vs\.?|v\.|between\s+\S+\s+and\s+\S+|did\s+\w+\s+meet|did\s+\w+\s+hit)\b"
NUMERICAL = (
    r"\b(?:what\s+(?:was|were|is|are)|how\s+much|how\s+many|revenue|income|margin|cash\s+flow|earnings|EPS|memberships?|subscribers?|net\s+adds?"
    r"|operating\s+income|free\s+cash\s+flow)\b"
)
NARRATIVE = r"\b(?:why\s+(?:did|does|was|is)|how\s+did|stance|strategy|position|drove|drivers?|explain|impact|effect|reason|rationale|narrative|story)\b"

# --- Fixed values: word lists -------------------------------------------------------------------------------------------
ENGLISH = (
    "the a an of in on to for and or is was are were be been has have had did do does what when where why how which this that these those with by from at "
    "as but if than then it its their they them we us our all more most any some"
).split()
KEY_TERM_STOPS = (
    "a an and are as at be by for from have has had in is it its of on or than that the their they this to was were with would could should will if rather "
    "instead while into over under primary primarily later earlier letter report filing"
).split()

# --- Fixed values: speakers, formal to casual ---------------------------------------------------------------------------
SPEAKERS = {
    "Theodore A. Sarandos": "Ted Sarandos",
    "Theodore Anthony Sarandos": "Ted Sarandos",
    "Spencer Adam Neumann": "Spencer Neumann",
    "Spence Neumann": "Spencer Neumann",
    "Gregory K. Peters": "Greg Peters",
    "Wilmot Reed Hastings": "Reed Hastings",
    "Wilmot Reed Hastings Jr": "Reed Hastings",
    "David B. Wells": "David Wells",
}
CASUAL_SPEAKERS = ("Ted Sarandos", "Spencer Neumann", "Greg Peters", "Reed Hastings", "David Wells", "Spencer Wang")

# --- Fixed values: concepts, label and statement -------------------------------------------------------------------------
OPERATIONS, BALANCE = "Condensed Consolidated Statements of Operations", "Condensed Consolidated Balance Sheets"
CASH, METRICS = "Condensed Consolidated Statements of Cash Flows", "Segment Information and Operating Metrics"
CONCEPTS = {
    "us-gaap:Revenues": ("Revenues", OPERATIONS),
    "us-gaap:CostOfRevenue": ("Cost of revenues", OPERATIONS),
    "us-gaap:GrossProfit": ("Gross profit", OPERATIONS),
    "us-gaap:OperatingExpenses": ("Operating expenses", OPERATIONS),
    "us-gaap:OperatingIncomeLoss": ("Operating income (loss)", OPERATIONS),
    "us-gaap:NetIncomeLoss": ("Net income (loss)", OPERATIONS),
    "us-gaap:EarningsPerShareBasic": ("Earnings per share, basic", OPERATIONS),
    "us-gaap:EarningsPerShareDiluted": ("Earnings per share, diluted", OPERATIONS),
    "us-gaap:WeightedAverageNumberOfSharesOutstandingBasic": ("Weighted-average shares outstanding, basic", OPERATIONS),
    "us-gaap:WeightedAverageNumberOfDilutedSharesOutstanding": ("Weighted-average shares outstanding, diluted", OPERATIONS),
    "us-gaap:IncomeTaxExpenseBenefit": ("Provision for income taxes", OPERATIONS),
    "us-gaap:InterestExpense": ("Interest expense", OPERATIONS),
    "us-gaap:IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest": ("Income before income taxes", OPERATIONS),
    "us-gaap:MarketingExpense": ("Marketing expense", OPERATIONS),
    "us-gaap:GeneralAndAdministrativeExpense": ("General and administrative expense", OPERATIONS),
    "us-gaap:ResearchAndDevelopmentExpense": ("Technology and development expense", OPERATIONS),
    "us-gaap:CashAndCashEquivalentsAtCarryingValue": ("Cash and cash equivalents", BALANCE),
    "us-gaap:Assets": ("Total assets", BALANCE),
    "us-gaap:AssetsCurrent": ("Total current assets", BALANCE),
    "us-gaap:Liabilities": ("Total liabilities", BALANCE),
    "us-gaap:LiabilitiesCurrent": ("Total current liabilities", BALANCE),
    "us-gaap:StockholdersEquity": ("Stockholders' equity", BALANCE),
    "us-gaap:LongTermDebtNoncurrent": ("Long-term debt", BALANCE),
    "us-gaap:LongTermDebtCurrent": ("Current portion of long-term debt", BALANCE),
    "us-gaap:AccountsPayableCurrent": ("Accounts payable", BALANCE),
    "us-gaap:NetCashProvidedByUsedInOperatingActivities": ("Net cash provided by operating activities", CASH),
    "us-gaap:NetCashProvidedByUsedInInvestingActivities": ("Net cash provided by (used in) investing activities", CASH),
    "us-gaap:NetCashProvidedByUsedInFinancingActivities": ("Net cash provided by (used in) financing activities", CASH),
    "us-gaap:CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect": (
        "Net change in cash, cash equivalents, and restricted cash",
        CASH,
    ),
    "nflx:ContentAssetsNet": ("Content assets, net", BALANCE),
    "nflx:ContentLiabilitiesCurrent": ("Content liabilities, current", BALANCE),
    "nflx:ContentLiabilitiesNoncurrent": ("Content liabilities, noncurrent", BALANCE),
    "nflx:AdditionstoStreamingContentAssets": ("Additions to content assets", CASH),
    "nflx:CostofServicesAmortizationofStreamingContentAssets": ("Amortization of content assets", CASH),
    "nflx:NumberOfPaidMemberships": ("Number of paid memberships", METRICS),
    "nflx:NumberOfPaidMembershipAdditionsLossesDuringPeriod": ("Paid memberships net additions", METRICS),
}
GEOGRAPHIC_AXIS, PRODUCT_AXIS, NOOP_MEMBER = "srt:StatementGeographicalAxis", "srt:ProductOrServiceAxis", "nflx:StreamingMember"
REGIONS = {"nflx:UnitedStatesAndCanadaMember": "UCAN", "us-gaap:EMEAMember": "EMEA", "srt:LatinAmericaMember": "LATAM", "srt:AsiaPacificMember": "APAC"}
COUNT_UNITS, PER_SHARE_UNITS = ("shares", "pure", "membership", "segment"), ("USDPerShare", "USDPershares")

# --- Fixed values: texts of decisions that a run takes without a model ------------------------------------------------------
GAP_NO_CANDIDATES = "Retriever returned no candidates."
GAP_ALL_REJECTED = "No candidates survived deterministic period/numerical pre-filters. Retry with reformulated query terms or broader period scope."
CLARIFICATION_TEXT = (
    "I can't answer this question from the Netflix corpus available to me — no verified evidence was found across the planned retrieval slots. "
    "Narrow the question to a specific metric, period, or filing so I can ground the answer in primary sources."
)
HARD_HALT_TEXT = "The run halted before an answer could be generated. The cause is recorded on the trace's degradation_cause field."
RETRY_HEAD = "These points of the answer were not accepted:"
RETRY_TAIL = "Answer again: name each refutation listed above, and give no number that a cited record does not have."
