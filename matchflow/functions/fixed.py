"""Word lists, lookup tables, constants and patterns.

Everything in this module is a fixed value that decides results; nothing here is logic.
Each list is a default argument somewhere and can be replaced by the caller.
"""

# --- skills -----------------------------------------------------------------
TECH_SKILLS = (
    # languages
    "python", "java", "javascript", "typescript", "c++", "c#", "ruby", "go", "golang",
    "rust", "scala", "kotlin", "swift", "php", "r", "matlab", "perl", "bash", "shell",
    # web
    "html", "css", "react", "reactjs", "react.js", "angular", "vue", "vuejs", "vue.js",
    "node", "nodejs", "node.js", "express", "django", "flask", "fastapi", "spring",
    "asp.net", ".net", "rails", "ruby on rails", "next.js", "nextjs", "nuxt",
    # databases
    "sql", "mysql", "postgresql", "postgres", "mongodb", "redis", "elasticsearch",
    "cassandra", "dynamodb", "oracle", "sqlite", "mariadb", "neo4j", "graphql",
    # cloud and operations
    "aws", "amazon web services", "azure", "gcp", "google cloud", "docker", "kubernetes",
    "k8s", "terraform", "ansible", "jenkins", "ci/cd", "github actions", "gitlab ci",
    "circleci", "travis ci", "helm", "prometheus", "grafana",
    # data
    "machine learning", "deep learning", "tensorflow", "pytorch", "keras", "scikit-learn",
    "sklearn", "pandas", "numpy", "scipy", "spark", "pyspark", "hadoop", "airflow",
    "tableau", "power bi", "looker", "data analysis", "data science", "nlp",
    "natural language processing", "computer vision", "opencv",
    # tools
    "git", "github", "gitlab", "bitbucket", "jira", "confluence", "agile", "scrum",
    "linux", "unix", "windows", "macos", "rest", "restful", "api", "microservices",
    "kafka", "rabbitmq", "celery", "nginx", "apache", "grpc",
)

SOFT_SKILLS = (
    "leadership", "communication", "teamwork", "problem solving", "problem-solving",
    "critical thinking", "project management", "time management", "analytical",
    "collaboration", "adaptability", "creativity", "attention to detail",
    "interpersonal", "presentation", "negotiation", "decision making", "strategic",
    "mentoring", "coaching", "cross-functional", "stakeholder management",
)

SKILL_ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "ml": "machine learning",
    "dl": "deep learning", "ai": "artificial intelligence", "react.js": "react",
    "reactjs": "react", "vue.js": "vue", "vuejs": "vue", "node.js": "node",
    "nodejs": "node", "postgres": "postgresql", "k8s": "kubernetes",
    "sklearn": "scikit-learn", "gcp": "google cloud", "aws": "amazon web services",
}

# Each class lists spellings that count as the same skill; the key names the class.
SKILL_CLASSES = {
    "react": ("react", "reactjs", "react.js", "react native"),
    "node": ("node", "nodejs", "node.js"),
    "vue": ("vue", "vuejs", "vue.js"),
    "angular": ("angular", "angularjs", "angular.js"),
    "python": ("python", "python3", "python2"),
    "javascript": ("javascript", "js", "ecmascript", "es6"),
    "typescript": ("typescript", "ts"),
    "machine learning": ("machine learning", "ml", "machine-learning"),
    "deep learning": ("deep learning", "dl", "deep-learning"),
    "postgresql": ("postgresql", "postgres", "psql"),
    "kubernetes": ("kubernetes", "k8s"),
    "amazon web services": ("amazon web services", "aws"),
    "google cloud": ("google cloud", "gcp", "google cloud platform"),
    "ci/cd": ("ci/cd", "cicd", "continuous integration", "continuous deployment"),
}

# --- keywords ---------------------------------------------------------------
OVERLAP_STOPWORDS = (
    "the", "and", "for", "with", "you", "your", "that", "this", "are", "will",
    "have", "has", "from", "our", "can", "all", "what", "about", "more", "work",
    "experience", "team", "ability", "skills", "including", "working", "strong",
)
KEYWORD_STOPWORDS = OVERLAP_STOPWORDS + (
    "looking", "join", "company", "role", "position", "job", "opportunity",
    "responsibilities", "requirements", "qualifications", "benefits",
)
DEGREE_WORDS = ("bachelor", "master", "phd", "degree", "bs", "ms", "ba", "ma")
EDUCATION_WORDS = ("degree", "bachelor", "master", "phd", "education")

# --- suggestions (wording is part of the result) ------------------------------
SUGGEST_ONE_SKILL = "Add '%s' to your skills section if you have experience with it."
SUGGEST_SKILLS = "Consider adding these key skills to your resume: %s"
SUGGEST_EXPERIENCE = "Add a work experience section with bullet points describing your achievements."
SUGGEST_NUMBERS = "Add quantifiable achievements (e.g., 'Increased sales by 20%', 'Managed team of 5')."
SUGGEST_EDUCATION = "Add an education section as the job listing mentions educational requirements."
SUGGEST_SUMMARY = "Add a professional summary at the top highlighting your key qualifications."
SUGGEST_LONGER = "Your resume may be too brief. Consider adding more detail about your experience."
SUGGEST_SHORTER = "Your resume may be too long. Consider condensing to highlight the most relevant experience."
SUGGEST_EMAIL = "Ensure your email address is clearly visible on the resume."
SUGGEST_CUSTOMISE = "Consider customizing your resume to better align with this specific job's requirements."

# --- semantic match -----------------------------------------------------------
SECTION_WEIGHTS = {"summary": 0.15, "experience": 0.40, "project": 0.25, "skills": 0.20}
# Where the summary weight goes when a profile has no summary.
SUMMARY_SHARES = {"experience": 0.5, "project": 0.3, "skills": 0.2}
WEAK, MODERATE, STRONG = 0.50, 0.65, 0.75
STYLE_STRONG = 0.70

BAND_TEXT = (
    (STRONG, "Strong match - well aligned with job requirements"),
    (MODERATE, "Good match - minor improvements possible"),
    (WEAK, "Moderate match - optimization recommended"),
    (None, "Weak match - significant gaps to address"),
)
MATRIX_TEXT = {
    "strong": "Strong match - well aligned with requirements",
    "good": "Good match - some optimization possible",
    "content": "Has skills but weak descriptions - optimize content",
    "keywords": "Good content but missing keywords - add required skills",
    "poor": "Needs work - significant gaps in skills and content",
}

# --- web pages -----------------------------------------------------------------
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "refid", "referrer", "source", "trk", "trackingid", "fbclid",
    "gclid", "mc_cid", "mc_eid", "_ga", "srsltid",
)
MAX_URL = 2000
URL_REQUIRED = "URL is required"
URL_SCHEME = "URL must start with http:// or https://"
URL_NO_HOST = "Invalid URL format - no domain found"
URL_TOO_LONG = "URL is too long (max 2000 characters)"

BLOCKED_STRONG = (
    "captcha", "verify you are human", "verify you are not a robot", "access denied",
    "bot detected", "automated access",
)
BLOCKED_WEAK = (
    "please enable javascript", "unusual traffic", "security check", "checking your browser",
)
BLOCKED_SHORT = 500

# (field, every string must occur, platform), first match wins
PLATFORM_RULES = (
    ("url", ("greenhouse.io",), "greenhouse"),
    ("url", ("boards.greenhouse",), "greenhouse"),
    ("url", ("lever.co",), "lever"),
    ("url", ("workday.com",), "workday"),
    ("url", ("myworkdayjobs.com",), "workday"),
    ("url", ("icims.com",), "icims"),
    ("url", ("smartrecruiters.com",), "smartrecruiters"),
    ("url", ("jobvite.com",), "jobvite"),
    ("url", ("taleo",), "taleo"),
    ("url", ("successfactors",), "successfactors"),
    ("url", ("myflorida.com",), "successfactors"),
    ("url", ("phenom",), "phenom"),
    ("url", ("ashbyhq.com",), "ashby"),
    ("html", ("icims_content_iframe",), "icims"),
    ("html", ("icims-widget",), "icims"),
    ("html", ("phapp.ddo",), "phenom"),
    ("html", ("data-ph-id",), "phenom"),
    ("html", ("greenhouse", "application/ld+json"), "greenhouse"),
    ("html", ("lever-jobs",), "lever"),
)

# entity, character: in the order they are decoded
# Tags that have no content and no closing tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# Named characters beyond those of TEXT_ENTITIES that selected texts may hold.
NAMED_CHARACTERS = (
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&bull;", "•"), ("&middot;", "·"), ("&hellip;", "…"), ("&euro;", "€"), ("&pound;", "£"), ("&copy;", "©"),
    ("&reg;", "®"), ("&trade;", "™"), ("&deg;", "°"), ("&agrave;", "à"), ("&aacute;", "á"), ("&acirc;", "â"),
    ("&atilde;", "ã"), ("&auml;", "ä"), ("&aring;", "å"), ("&aelig;", "æ"), ("&ccedil;", "ç"), ("&egrave;", "è"),
    ("&eacute;", "é"), ("&ecirc;", "ê"), ("&euml;", "ë"), ("&igrave;", "ì"), ("&iacute;", "í"), ("&icirc;", "î"),
    ("&iuml;", "ï"), ("&ntilde;", "ñ"), ("&ograve;", "ò"), ("&oacute;", "ó"), ("&ocirc;", "ô"), ("&otilde;", "õ"),
    ("&ouml;", "ö"), ("&oslash;", "ø"), ("&ugrave;", "ù"), ("&uacute;", "ú"), ("&ucirc;", "û"), ("&uuml;", "ü"),
    ("&szlig;", "ß"), ("&Agrave;", "À"), ("&Aacute;", "Á"), ("&Auml;", "Ä"), ("&Ccedil;", "Ç"), ("&Egrave;", "È"),
    ("&Eacute;", "É"), ("&Ntilde;", "Ñ"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"),
)
TEXT_ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"), ("&apos;", "'"),
)
DESCRIPTION_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"),
    ("&nbsp;", " "),
)

# CSS selectors per field, first one with text wins
FIELD_SELECTORS = {
    "job_title": (
        ".jobTitle h1", ".job-title h1", "#jobTitle", 'h1[class*="title"]', 'h1[class*="job"]',
        '[data-automation="job-title"]', ".posting-headline h2",
    ),
    "location": (
        ".jobLocation", ".job-location", "#job-location", '[class*="location"]',
        '[data-automation="location"]', ".jobGeoLocation",
    ),
    "company": (
        ".company-name", ".employer-name", '[class*="company"]', '[data-automation="company"]',
        ".jobCompany",
    ),
    "description": (
        ".jobdescription", ".job-description", "#job-description", "#job-html",
        '[class*="description"]', ".posting-requirements", "article", ".job-details",
        ".job-content",
    ),
}

# --- posting text ----------------------------------------------------------------
BOILERPLATE = (
    r"Equal\s+Opportunity\s+Employer",
    r"We\s+are\s+an?\s+equal\s+opportunity",
    r"All\s+qualified\s+applicants",
    r"E-Verify",
)
POSTING_LADDER = {
    "job_title": (
        r"(?i)(?:Job\s*Title|Position|Role)\s*[:\-]\s*(.+?)(?:\n|$)",
        r"(?m)^(.+?)\s+at\s+.+$",
    ),
    "company": (
        r"(?i)(?:Company|Employer|Organization)\s*[:\-]\s*(.+?)(?:\n|$)",
        r"(?m)(?:at|@)\s+([A-Z][A-Za-z0-9\s&.,]+?)(?:\n|$|\s+is)",
    ),
    "location": (
        r"(?i)(?:Location|Where|Office)\s*[:\-]\s*(.+?)(?:\n|$)",
        r"(?i)(Remote|Hybrid|On-?site)",
        r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?,\s*[A-Z]{2})",
    ),
    "apply_url": (
        r"(?i)(?:Apply\s*(?:here|now|at)?\s*[:\-]?\s*)?(https?://\S+)",
        r"(?i)(https?://[^\s]+(?:careers|jobs|apply|lever|greenhouse|workday)[^\s]*)",
    ),
}

# --- profile text ------------------------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONES = (
    r"\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    r"\([0-9]{3}\)\s*[0-9]{3}[-.\s]?[0-9]{4}",
    r"[0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4}",
    r"\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{3}",
)
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+/?"
CITY_STATE = r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)?),\s*([A-Z]{2})\b"
NOT_STATES = ("BS", "BA", "MS", "MA", "MD", "DO", "JD", "PhD")
LOCATION_CHARS = 500

SECTION_HEADERS = {
    "experience": r"WORK\s+EXPERIENCE|PROFESSIONAL\s+EXPERIENCE|EMPLOYMENT(?:\s+HISTORY)?|CAREER\s+HISTORY",
    "education": r"EDUCATION(?:AL\s+BACKGROUND)?|ACADEMIC\s+BACKGROUND|QUALIFICATIONS",
    "skills": r"TECHNICAL\s+SKILLS(?:\s+&\s+TOOLS)?|SKILLS|COMPETENCIES|EXPERTISE|TECHNOLOGIES|PROFICIENCIES",
    "projects": r"PERSONAL\s+PROJECTS|PROJECTS|PORTFOLIO",
}
MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
    r"Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
DATE_RANGE = rf"(?i){MONTH}\s+\d{{4}}\s*[-–]\s*(?:{MONTH}\s+\d{{4}}|Present|Current)"
# Dates of sections without any range of months.
LOOSE_DATE = rf"(?i){MONTH}[\s,]*\d{{4}}|\d{{1,2}}/\d{{4}}|\d{{4}}\s*[-–]\s*(?:\d{{4}}|present|current)"
JOB_TITLE = (
    r"(?i)\b((?:Senior|Junior|Lead|Staff|Principal|Associate|Assistant)?\s*"
    r"(?:Software|Frontend|Backend|Full[\s-]?Stack|Data|DevOps|Cloud|Machine Learning|ML|AI)?\s*"
    r"(?:Engineer|Developer|Architect|Manager|Analyst|Consultant|Scientist|Director|"
    r"Specialist|Administrator|Designer|Intern|Coordinator|Lead|Superintendent|Supervisor|"
    r"Vice President|VP|CEO|CTO|CFO|COO))\b"
)
# Runs are entered at their first letter only: where that fails, so would every later start in the run.
COMPANY_LEAD = r"(?i)(?<![A-Z][\s&]{0,40})([A-Z][A-Za-z\s&]+?)"
COMPANY_PLACE = r"(?i)(?<![A-Za-z][\s&\.\-]{0,40})([A-Za-z][A-Za-z\s&\.\-]+?),\s*(?:[A-Za-z\s]+,\s*)?([A-Z]{2})\s"
BULLET = r"[•\-\*]\s*(.+?)(?=[•\-\*]|$)"
INSTITUTION = (
    r"(?i)\b((?:Oregon State|Northeastern|Stanford|MIT|Harvard|Yale|Berkeley|UCLA|USC|NYU|"
    r"Columbia|Cornell|Princeton|Duke|Northwestern|Carnegie Mellon|Georgia Tech|"
    r"Boston|Michigan|Texas|Penn State|Ohio State|Florida State|Arizona State|"
    r"Washington|Virginia|Illinois|Wisconsin|Minnesota|Purdue|Maryland|"
    r"Rutgers|Indiana|Iowa State|Colorado|Tennessee|Kentucky|Alabama|LSU|"
    r"Notre Dame|Georgetown|Brown|Dartmouth|Vanderbilt|Rice|Emory)\s+"
    r"(?:University|College|Institute)|"
    r"University\s+of\s+[A-Z][a-z]+\b(?:\s+[A-Za-z]+\b)*+|"
    r"[A-Z][a-z]+\s+State\s+University|"
    r"(?:(?<![A-Z]{2}\s)|(?<=(?:University|College|Institute)\s))"
    r"[A-Z][a-z]+\b(?:(?:\s+(?!(?:College|Institute)\b)[A-Z][a-z]+\b)*+\s+(?:College|Institute)\b)++)\b"
)
ANY_UNIVERSITY = (
    r"\b(?:(?<!\b[A-Z][a-z]{1,30}\s)|(?<=\bUniversity\s))"
    r"([A-Z][a-z]+\b(?:(?:\s+(?!University\b)[A-Z][a-z]+\b)*+\s+University\b)++)"
)
NOT_INSTITUTIONS = (
    "bachelor", "master", "education", "science", "arts", "engineering",
    "computer", "data", "business", "management", "associate", "doctor",
)
DEGREE = (
    r"(?i)(Bachelor(?:\s+of\s+(?:Science|Arts))?|Master(?:\s+of\s+(?:Science|Arts))?|"
    r"B\.S\.?|B\.A\.?|M\.S\.?|M\.A\.|Ph\.?D\.?|MBA|Associate|Postbaccalaureate|Doctorate)"
)
FIELD_OF_STUDY = (
    r"(?i)(?:Bachelor|Master|B\.?S\.?|B\.?A\.?|M\.?S\.?|M\.?A\.?)\s+(?:of\s+\w+\s+)?in\s+"
    r"([A-Za-z\s]+?)(?:\s*[\|,\(]|$)"
)
GPA = r"(?i)GPA[:\s]*([0-4]\.[0-9]{1,2})"
EDUCATION_DATE = rf"(?i)(?:Expected\s+)?{MONTH}\s+\d{{4}}|\b\d{{4}}\b"
PROJECT_HEAD = r"(?i)(?<![A-Z][0-9\s\-]{0,40})([A-Z][A-Za-z0-9\s\-]+?)[\s]*\(([^)]+)\)[:\s]*"
SUMMARY_TEXT = r"(?is)(?:summary|objective|profile|about\s*me)[:\s]*(.+?)(?=\n\n|experience|education|skills)"
NUMBERS = r"\d+%|\$\d+|\d+ (years?|months?|projects?)"

# --- rewrites -------------------------------------------------------------------------
KEY_SEPARATOR = "|||"
KEY_POSTING_CHARS = 2000
UNSUPPORTED = "Unsupported section type"

# --- stored columns (length rules of the stored tables) -----------------------------------
POSTING_LENGTHS = {"job_title": 255, "company": 255, "location": 255, "description_hash": 64}
PROFILE_LENGTHS = {"full_name": 255, "email": 255, "phone": 50, "location": 255, "file_hash": 64}
