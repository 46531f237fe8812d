"""Word lists and patterns of the feature functions. All are parameters' defaults."""

# Results depend on each of them.
SKILLS = (
    "python", "sql", "tableau", "power bi", "excel", "pandas", "numpy", "scikit-learn", "sklearn", "pytorch", "tensorflow", "machine learning",
    "deep learning", "nlp", "computer vision", "spark", "pyspark", "kafka", "kubernetes", "docker", "aws", "gcp", "azure", "airflow", "dbt", "snowflake",
    "databricks", "java", "c++", "microservices", "statistics", "a/b testing", "experimentation", "analytics", "data engineering", "mlops",
)
SENIORITY = (
    ("internship", ("intern", "internship")), ("staff_principal", ("staff", "principal", "distinguished")), ("senior", ("senior", "sr.", "sr ")),
    ("entry_junior", ("junior", "jr.", "entry level", "new grad", "graduate")), ("lead_manager", ("lead", "manager")),
)
REMOTE = (("remote", ("remote",)), ("hybrid", ("hybrid",)), ("onsite", ("on-site", "onsite")))
EMPLOYMENT = (
    ("unpaid", ("unpaid", "volunteer")), ("contract", ("contract", "contractor", "c2c", "w2 contract")), ("temporary", ("temporary", "temp ")),
    ("internship", ("internship", "intern ")), ("part-time", ("part-time", "part time", "part_time")), ("full-time", ("full-time", "full time", "full_time")),
)
COMPANY_TYPE = (
    ("defense_military", ("defense", "military", "army", "navy", "air force", "dod ")), ("startup", ("startup", "seed stage", "series a", "venture-backed")),
    ("research_lab", ("research lab", "laboratory", "university", "institute")), ("large_company", ("fortune 500", "global leader", "large enterprise", "multinational")),
)
SPONSORSHIP = (
    ("no_sponsorship", ("will not sponsor", "unable to sponsor", "no sponsorship")),
    ("mentions_sponsorship_or_work_auth", ("h-1b", "h1b", "visa sponsorship", "sponsor visa", "work authorization")),
)
INVALID = ("", "false", "true", "none", "null", "nan", "n/a", "na", "unknown", "unknown employer", "unknown location")
QUALITY_WEIGHTS = {
    "country": 8, "city": 4, "state": 4, "salary_any": 14, "employment_type_any": 12, "company_url": 8, "raw_categories": 12, "raw_work_types": 8,
    "raw_qualifications": 5, "schema_org_employment_type": 8, "schema_org_skills": 8, "schema_org_experience_requirements": 9,
}
TITLE_FAMILIES = {
    "ml_related": ("machine learning engineer", "ml engineer", "data scientist", "applied scientist", "research scientist", "ai engineer", "artificial intelligence engineer"),
    "research_ai": ("research scientist", "ai researcher", "machine learning researcher", "applied scientist"),
    "ml_infra": ("mlops engineer", "machine learning ops engineer", "ml platform engineer", "ml infrastructure engineer", "machine learning platform engineer", "machine learning infrastructure engineer", "ai infrastructure engineer", "mlops"),
    "analytics_entry": ("data analyst", "junior data scientist", "analytics analyst", "business analyst", "analytics engineer"),
    "bi_analytics": ("bi analyst", "bi engineer", "business intelligence analyst", "business intelligence engineer", "tableau developer", "power bi developer"),
    "data_engineering": ("data engineer", "etl engineer", "big data engineer", "hadoop engineer", "data platform engineer"),
    "software_backend": ("software engineer", "backend engineer", "java developer", "python developer", "application developer"),
}
DESCRIPTION_FAMILIES = {
    "ml_related": ("machine learning", "artificial intelligence", "deep learning", "model training", "predictive modeling", "computer vision", "natural language processing"),
    "research_ai": ("research scientist", "ai research", "machine learning research", "publish", "publication", "experiment"),
    "ml_infra": ("mlops", "model serving", "feature platform", "feature store", "kubernetes", "spark", "kafka"),
    "analytics_entry": ("dashboard", "business analytics", "reporting", "data analysis", "tableau", "power bi"),
    "bi_analytics": ("business intelligence", "bi dashboard", "tableau", "power bi", "looker"),
    "data_engineering": ("data pipeline", "etl", "data warehouse", "hadoop", "big data", "airflow"),
    "software_backend": ("backend service", "microservice", "api development", "java", "python", "application development"),
}
DEFENSE = (
    "govcio", "mantech", "booz allen", "raytheon", "lockheed", "northrop", "general dynamics", "leidos", "saic", "l3harris", "bae systems", "caci", "defense",
    "department of defense", "dod", "defense contractor", "military", "military contractor", "federal contractor", "government contractor", "clearance",
    "security clearance", "active clearance", "top secret", "top secret sci", "ts sci", "ts/sci", "sci",
)
SPONSOR_FRIENDLY = (
    "google", "amazon", "microsoft", "meta", "apple", "nvidia", "oracle", "salesforce", "ibm", "intel", "adobe", "servicenow", "indeed", "general motors",
    "capital one", "jpmorgan", "bloomberg", "databricks", "openai", "anthropic", "deepmind",
)
#: Titles as patterns, where words next to each other aren't all that is asked.
TITLE_PATTERNS = {"ml_infra": (r"ai\s*/\s*mlops engineer",)}
WEAK_TITLES = (
    "bi engineer", "data engineer", "devops engineer", "cloud engineer", "security support engineer", "automation engineer", "marketing engineer", "business analyst",
    "data analyst", "python developer", "hadoop admin", "big data admin", "data labeling analyst",
)
GENERIC_TITLES = {
    "devops": r"\bdevops\b", "backend": r"\bback[-\s]?end\b", "software_engineer": r"\bsoftware engineer\b", "fullstack": r"\bfull[-\s]?stack\b",
    "java": r"\bjava (?:developer|engineer|software)\b", "cloud": r"\bcloud engineer\b", "security": r"\bsecurity (?:support )?engineer\b",
}
LEVELS = {
    "senior": r"(?:\bsenior\b|\bsr\.?(?:\s|$|[-,/]))", "staff": r"\bstaff\b", "principal": r"\bprincipal\b", "lead": r"\blead\b", "manager": r"\bmanager\b", "director": r"\bdirector\b",
    "head": r"\bhead(?:\s+of)?\b", "distinguished": r"\bdistinguished\b", "iii": r"\b(?:iii|level\s*iii|level\s*3)\b",
}
JUNIOR_LEVELS = {"junior": r"\b(?:junior|jr\.?|jr|entry[-\s]?level|new grad|graduate)\b", "internship": r"\b(?:intern|internship)\b"}
RESEARCH_LABS = ("deepmind", "openai", "anthropic", "google brain", "microsoft research", "meta ai", "research lab", "ai lab")
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT",
    "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
)
BAY_AREA = (
    "san francisco", "sf", "san jose", "oakland", "palo alto", "mountain view", "santa clara", "sunnyvale", "cupertino", "fremont", "menlo park", "redwood city",
    "berkeley", "bay area", "silicon valley", "california",
)
NON_US = ("uk", "united kingdom", "england", "scotland", "wales", "northern ireland", "ireland", "australia", "canada", "india", "singapore", "germany", "france")
NON_US_CITIES = ("london", "slough", "sheffield", "uxbridge", "dublin", "sydney", "toronto", "vancouver", "middlesex")
REMOTE_TERMS = ("remote", "anywhere in the us", "anywhere in the united states")
REMOTE_NEGATIONS = ("not remote", "no remote", "onsite only", "on site only")
CORPORATE = ("inc", "incorporated", "llc", "l l c", "ltd", "limited", "corp", "corporation", "co", "com", "company", "plc", "lp", "llp", "services", "service", "technologies", "technology", "usa", "us")
FILING_FAMILIES = (
    ("ml_ai", ("machine learning", "ml engineer", "mlops", "artificial intelligence", "ai engineer", "deep learning", "computer vision", "natural language processing", "nlp", "applied scientist", "research scientist")),
    ("data_engineering", ("data engineer", "analytics engineer", "etl", "data pipeline", "big data", "spark", "kafka")),
    ("data_analytics", ("data scientist", "data analyst", "business intelligence", "bi analyst", "analytics", "statistician")),
    ("software_engineering", ("software", "developer", "programmer", "devops", "site reliability", "systems engineer", "platform engineer")),
)
FILING_CODES = (
    ("data_analytics", ("15-2051",)), ("software_engineering", ("15-1252", "15-1253", "15-1254", "15-1256", "15-1257", "15-1258")),
    ("data_engineering", ("15-1243", "15-1244", "15-1241")), ("other_tech", ("15-", "17-")),
)
SCORE_WEIGHTS = {"embedding_similarity": 0.27, "skill_match": 0.17, "target_role": 0.23, "salary": 0.09, "location": 0.08, "company": 0.05, "sponsorship": 0.06, "employment_type": 0.06}
DISPLAY_STOPWORDS = ("i", "ii", "iii", "iv", "jr", "junior", "sr", "senior", "staff", "principal", "lead", "remote", "hybrid", "onsite")
#: The English stop words of scikit-learn.
STOP_WORDS = frozenset("""
a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at
back be became because become becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during
each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front full further
get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less ltd
made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own
part per perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such system
take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty two
un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves
""".split())
