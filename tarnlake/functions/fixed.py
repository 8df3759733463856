"""Fixed values that results depend on. Plain data: patterns, word lists, weights, thresholds.

Patterns are written with \\b and $; functions.text turns them into forms that mean the same in Java.
"""

# ---- fixed values: memory types ----
SEMANTIC = [
    r"\b(prefers?|likes?|loves?|hates?|dislikes?|enjoys?|favou?rites?)\b",
    r"\b(always|never|usually|typically|generally)\b",
    r"\b(is a|is an|are a|are an|works? (as|at|for))\b",
    r"\b(allergic|intolerant|sensitive)\b",
    r"\b(vegetarian|vegan|kosher|halal)\b",
    r"\b(name is|called|known as|goes by)\b",
    r"\b(lives? in|based in|from|located)\b",
    r"\b(speaks?|fluent|language)\b",
    r"\b(birthday|born on|age is)\b",
    r"\b(member(ship)?|loyal(ty)?|status)\b",
]
EPISODIC = [
    r"\b(booked|cancelled|purchased|ordered|visited|traveled|flew|arrived|went|came|met|saw|heard)\b",
    r"\b(on (january|february|march|april|may|june|july|august|september|october|november|december))\b",
    r"\b(on \d{1,2}(st|nd|rd|th)?|on \d{4}-\d{2}-\d{2})\b",
    r"\b(yesterday|today|last (week|month|year|time|night|monday|tuesday|wednesday|thursday|friday|saturday|sunday))\b",
    r"\b(just (now|did|said|asked|mentioned))\b",
    r"\b(this (morning|afternoon|evening|session|week|weekend))\b",
    r"\b(recently|earlier|previously|ago)\b",
    r"\b(complained|requested|asked (about|for)|mentioned|said|told)\b",
    r"\b(searched|looked|browsed|viewed|clicked)\b",
    r"\b(every (morning|evening|night|day|week|month|monday|tuesday|wednesday|thursday|friday|saturday|sunday))\b",
    r"\b(happened|occurred|took place|experience[ds]?)\b",
    r"\b(at \d{1,2}(:\d{2})?\s*(am|pm))\b",
    r"\b(during (the|my|our|a))\b",
]
PROCEDURAL = [
    r"\b(when (booking|searching|looking|planning|ordering|processing|handling|deploying|building|running|testing|creating|updating|deleting|configuring))\b",
    r"\b(always (check|verify|confirm|look|search|use|apply|include))\b",
    r"\b(first[,]?\s+(do|run|check|verify|confirm|look|create|build|install|set up|configure|ensure|open|start|log in|connect))\b",
    r"\b(step \d|steps?:)\b",
    r"\b(before (booking|purchasing|confirming|sending|submitting|deploying|merging|pushing|releasing))\b",
    r"\b(after (booking|purchasing|confirming|completing|deploying|merging|building))\b",
    r"\b(make sure (to|that))\b",
    r"\b(don'?t forget (to|that))\b",
    r"\b(workflow|process|procedure|routine|pipeline)\b",
    r"\b(if .+ then)\b",
    r"\b(instructions?|guidelines?|rules?)\b",
    r"\bfor this (user|customer|client|account)\b",
    r"\b(to deploy|to build|to release|to set up|to configure|to install)\b",
    r"\b(then\s+(run|build|push|deploy|tag|create|send|check|verify|execute|restart|update))\b",
    r"\b(how to)\b",
]

# ---- fixed values: entities ----
PERSON = [
    r"\b(?:name is|called|named|known as|goes by)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
    r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
    r"\b(?:does|did|has|have|is|was|do|can|will|would|could|should)\s+([A-Z][a-z]+)\b",
    r"\b([A-Z][a-z]+)(?:'s)\b",
]
LOCATION = [
    r"\b(?:in|to|from|at|near|around|visiting)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
    r"(?i)\b(New York|San Francisco|Los Angeles|Hong Kong|United Kingdom|United States|North America|South America|Central Park)\b",
]
ORGANIZATION = [
    r"\b(?:works?\s+(?:at|for)|employed\s+(?:at|by)|company\s+(?:is|called))\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
    r"\b([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*)\s+(?:Inc|Corp|LLC|Ltd|Company|Co|Group|Foundation)\b",
]
PREFERENCE = [
    r"(?i)\b(?:prefers?|likes?|loves?|enjoys?|favou?rites?)\s+(.+?)(?:\.|,|$)",
    r"(?i)\b(?:hates?|dislikes?|avoids?|allergic to)\s+(.+?)(?:\.|,|$)",
]
TOPIC = [r"(?i)\b(?:about|regarding|concerning|related to)\s+(.+?)(?:\.|,|$)"]
TYPE_RANK = {"person": 5, "technology": 4, "tool": 4, "organization": 3, "location": 2, "preference": 1, "topic": 0}
TYPE_CONFIDENCE = {"person": 0.7, "location": 0.6, "organization": 0.6, "preference": 0.5, "topic": 0.4}
#: term, type, confidence
VOCABULARY = [
    ("TypeScript", "technology", 0.8), ("JavaScript", "technology", 0.8), ("Go", "technology", 0.7), ("Rust", "technology", 0.8),
    ("Python", "technology", 0.8), ("Java", "technology", 0.7), ("Ruby", "technology", 0.8), ("Swift", "technology", 0.7),
    ("Kotlin", "technology", 0.8), ("PHP", "technology", 0.8), ("Deno", "technology", 0.8), ("Node.js", "technology", 0.8),
    ("VS Code", "tool", 0.9), ("VSCode", "tool", 0.9), ("Cursor", "tool", 0.9), ("Vim", "tool", 0.8), ("Neovim", "tool", 0.8), ("IntelliJ", "tool", 0.8),
    ("PostgreSQL", "technology", 0.9), ("Redis", "technology", 0.9), ("MongoDB", "technology", 0.9), ("MySQL", "technology", 0.9), ("SQLite", "technology", 0.9),
    ("React", "technology", 0.8), ("Next.js", "technology", 0.8), ("Express", "technology", 0.7), ("Prisma", "technology", 0.9),
    ("GraphQL", "technology", 0.8), ("REST", "technology", 0.7), ("gRPC", "technology", 0.8),
    ("Jest", "tool", 0.8), ("Vitest", "tool", 0.8), ("pytest", "tool", 0.8), ("Cypress", "tool", 0.8), ("Playwright", "tool", 0.8),
    ("Docker", "technology", 0.9), ("Kubernetes", "technology", 0.9), ("Helm", "tool", 0.8), ("Terraform", "tool", 0.8),
    ("GitHub Actions", "tool", 0.8), ("GitHub", "tool", 0.7), ("Git", "tool", 0.7),
    ("npm", "tool", 0.7), ("pnpm", "tool", 0.8), ("yarn", "tool", 0.7),
    ("ESLint", "tool", 0.8), ("Prettier", "tool", 0.8), ("EditorConfig", "tool", 0.8),
    ("Pino", "tool", 0.8), ("OpenTelemetry", "technology", 0.8), ("Prometheus", "tool", 0.8),
    ("LaunchDarkly", "tool", 0.9), ("AWS", "technology", 0.8), ("ECS", "technology", 0.7), ("Fargate", "technology", 0.8), ("Slack", "tool", 0.8),
    ("Turborepo", "tool", 0.8), ("lazygit", "tool", 0.8), ("husky", "tool", 0.7), ("Stripe", "tool", 0.8), ("Kafka", "tool", 0.8),
    ("Neo4j", "technology", 0.8), ("Tailwind", "technology", 0.8),
]
ENTITY_STOPWORDS = (
    "the a an and or but is are was were be been being have has had do does did will would could should may might shall can need must "
    "that this these those it its my your his her our their i you he she we they me him us them what which who whom when where how "
    "all each every both few more most some any no not only very just also too user agent memory always never usually typically "
    "then first next after before while during since until because if although though even however yet so therefore thus hence"
).split()
QUERY_STOPWORDS = (
    "What When Where How Who Which Why Does Did Has Have Is Was Do Can Will Would Could Should Are Were May The This That These Those "
    "For From With About Into After Before During Between Through Over Under Since Until Many Much Most Some Any All Each Every Both Few Several No Not"
).split()
QUERY_ENTITY = r"\b([A-Z][a-z]{1,})\b"

# ---- fixed values: arbitration ----
NEGATIONS = [
    (r"\b(is|are|was|were)\s+(?:a\s+)?(\w+)", r"\b(is|are|was|were)\s+not\s+(?:a\s+)?(\w+)"),
    (r"\b(likes?|loves?|enjoys?|prefers?)\b", r"\b(hates?|dislikes?|avoids?|doesn'?t\s+like)\b"),
    (r"\b(always)\b", r"\b(never)\b"),
    (r"\b(vegetarian|vegan)\b", r"\b(meat|steak|burger|chicken|pork|bacon)\b.*\b(loves?|enjoys?|prefers?|eats?)\b"),
    (r"\b(can)\b", r"\b(cannot|can'?t)\b"),
    (r"\b(true)\b", r"\b(false)\b"),
    (r"\b(yes)\b", r"\b(no)\b"),
]
TEMPORAL_MARKERS = [
    r"\b(now|currently|as of|since|recently|today|this (week|month|year))\b",
    r"\b(changed|updated|switched|moved|no longer|stopped|started)\b",
    r"\b(used to|formerly|previously|was|were)\b",
    r"\b(20\d{2})\b",
    r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d",
]
SUPERSESSION = [
    r"\b(switched|moved|changed|migrated)\s+(from|to)\b",
    r"\b(no longer|stopped|dropped|replaced|now\s+uses?)\b",
    r"\b(instead of|rather than|over)\b",
    r"\b(used to|formerly|previously)\b",
]
ELABORATION_STOPWORDS = (
    "the that this with from they have been were will would could should does about into than then them when what which their there these those some also just very much"
).split()
KEYWORD_STOPWORDS = ELABORATION_STOPWORDS + "uses using used alex team project prefers".split()

# ---- fixed values: queries ----
AGGREGATION = [
    r"\bwhat\b.+\bhas\b.+\b(done|read|painted|bought|made|visited|seen|attended|played|written|tried|started|taken|learned|joined|collected|adopted|rescued)\b",
    r"\bwhat\b.+\b(activities|events|books|hobbies|pets|instruments|items|things|sports|classes|courses|projects|goals|interests)\b",
    r"\bwhat\b.+\bdo(es)?\b.+\bdo\b",
    r"\bhow many\b.+\b(times|events|activities|pets|books|hobbies|children|kids)\b",
    r"\bwhat\s+(?:are|were)\s+\w+'?s?\s+(?:pet|children|kid|hobby|activit|instrument|book|sport|interest)",
    r"\bwhere\s+has\b",
    r"\blist\s+(?:all|the)\b",
    r"\bwhat\s+(?:all|different)\b",
    r"\bname\s+(?:all|the)\b",
    r"\bcan\s+you\s+(?:list|name|tell\s+me\s+all)\b",
    r"\bwho\s+supports?\b",
    r"\bwhat\s+(?:type|kind|sort)s?\s+(?:of|are)\b",
    r"\bwhat\s+(?:symbols?|instruments?|careers?)\s+(?:are|does|do|has|have)\b",
    r"\bwhat\s+does\s+\w+\s+do\s+(?:to|for|with)\b",
]
TEMPORAL_QUERY = [r"\bwhen\b", r"\bwhat\s+(date|year|month|day|time)\b", r"\bhow\s+long\b", r"\bsince\s+when\b", r"\b(recently|lately|latest|most\s+recent)\b"]
RECENCY_QUERY = r"\b(recently|lately|latest|most\s+recent)\b"
MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "(" + "|".join(MONTHS) + ")"
DATES = [
    rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b",
    rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"\b{_MONTH}\s+\d{{4}}\b",
    rf"\bin\s+(early|mid|late)\s+{_MONTH}",
    r"\b\d{4}\b",
]
DAY_MONTH_YEAR = rf"\b(\d{{1,2}})\s+{_MONTH}\s+(\d{{4}})\b"

# ---- fixed values: weights and thresholds ----
MIN_SIMILARITY = 0.35
MEMORY_WEIGHTS = {"similarity": 0.65, "recency": 0.15, "importance": 0.15, "frequency": 0.05}
FACT_WEIGHTS = {"similarity": 0.70, "recency": 0.15, "importance": 0.15}
RECENCY_LAMBDA = 0.01
TEMPORAL_BOOST, RECENT_BOOSTS = 1.3, (1.5, 1.3, 1.1)
RRF_K, RRF_BONUS = 60, 0.05
RERANK_TOP, RERANK_WEIGHTS, RERANK_FLOOR = 10, (0.6, 0.4), 0.2
GRAPH_SIMILARITY = 0.45
JACCARD, SAME_SUBJECT, ELABORATED = 0.7, 0.4, 0.7
HIGH_SCORE, LOW_SCORE, HEADER_TOKENS, LEAST_REST, TOKENS_PER_WORD = 0.4, 0.2, 15, 20, 1.3
#: dedup and conflict thresholds by kind of embedding
THRESHOLDS = {"local": (0.85, 0.65), "openai": (0.95, 0.80), "azure": (0.95, 0.80)}
DIMENSIONS = {"local": 384, "openai": 1536, "azure": 3072}
FACT_DUPLICATE, FACT_AMBIGUOUS = 0.92, 0.70
DECAY, DECAY_FLOOR, ARCHIVE_DAYS = 0.95, 0.05, 30
TOKEN_BUDGET, COST_PER_CALL = 4000, 0.0005
HEADERS = {"semantic": "## ADDITIONAL CONTEXT", "episodic": "## HISTORY", "procedural": "## PROCEDURES"}
FACTS_HEADER = "## FACTS"
EMPTY_RECALL = "No relevant memories found."
