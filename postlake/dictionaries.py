"""Words, patterns and numbers that the rules use."""

# Results depend on exactly these.

ROLES = {
    "devops": ["devops engineer", "sre engineer", "site reliability engineer", "platform engineer", "infrastructure engineer", "cloud engineer", "reliability engineer", "cloud architect", "devsecops engineer", "devops", "sre", "site reliability", "dev ops engineer", "systems engineer", "systems administrator", "platform ops", "cloud ops", "dev secops", "devops lead"],
    "backend": ["backend engineer", "backend developer", "back-end engineer", "back-end developer", "back end engineer", "back end developer", "server engineer", "server developer", "api engineer", "api developer", "software engineer", "software developer", "backend", "back-end", "back end"],
    "frontend": ["frontend engineer", "frontend developer", "front-end engineer", "front-end developer", "front end engineer", "front end developer", "ui engineer", "ux engineer", "web developer", "web engineer", "frontend", "front-end", "front end"],
    "fullstack": ["full stack engineer", "fullstack engineer", "full-stack engineer", "full stack developer", "fullstack developer", "full stack", "fullstack", "full-stack"],
    "data": ["data scientist", "data engineer", "ml engineer", "machine learning engineer", "ai engineer", "artificial intelligence", "data analyst", "data science"],
    "mobile": ["mobile engineer", "mobile developer", "ios engineer", "android engineer", "android developer", "ios developer"],
    "qa": ["qa engineer", "quality assurance", "test engineer", "automation engineer", "qa", "test automation"],
    "security": ["security engineer", "devsecops", "cybersecurity", "security analyst", "security architect"],
}
JUNIOR = [r"\bjunior\b", r"\bentry[\s-]?level\b", r"\bassociate\b", r"\bgraduate\b", r"\bnew grad\b", r"\b0[\s-]?2\s*years?\b", r"\b1[\s-]?2\s*years?\b", r"\b0\s*year\b", r"\b1\s*year\b", r"\b2\s*years?\b", r"\bearly career\b", r"\bentry\b", r"\btrainee\b", r"\bapprentice\b", r"\bi\b", r"\bintern\b"]
SENIOR = [r"\bsenior\b", r"\bsr\.?\b", r"\bstaff\b", r"\bprincipal\b", r"\blead\b", r"\bhead of\b", r"\bmanager\b", r"\bdirector\b", r"\bvp\b", r"\b5\+?\s*years?\b", r"\b6\+?\s*years?\b", r"\b7\+?\s*years?\b", r"\b8\+?\s*years?\b", r"\b10\+?\s*years?\b"]
REMOTE = [r"\bworldwide\b", r"\banywhere\b", r"\bglobal\b", r"\bremote anywhere\b", r"\bwork from anywhere\b", r"\bfully remote\b", r"\b100%\s*remote\b", r"\bremote\s*-\s*global\b", r"\binternational\b", r"\bno location restriction\b", r"\bopen to all\b", r"\bapac\b", r"\bemea\b", r"\bremote\b"]
GLOBAL_IN_TEXT = [r"\bremote\b", r"\bworldwide\b", r"\banywhere\b", r"\bglobal\b", r"\binternational\b", r"\bopen to all\b", r"\bno location restriction\b"]
US_ONLY = [r"\bus\s*only\b", r"\busa\s*only\b", r"\bunited\s*states\s*only\b"]
REGION_ONLY = [*US_ONLY, r"\beu\s*only\b", r"\beurope\s*only\b", r"\buk\s*only\b", r"\bcanada\s*only\b", r"\bindia\s*only\b", r"\bindia-only\b"]
ON_SITE = [r"\bhybrid\b", r"\bonsite\b", r"\bon-site\b", r"\bin-office\b", r"\bin office\b"]
CLOUD_TOOLS = [r"\baws\b", r"\bgcp\b", r"\bazure\b", r"\bkubernetes\b", r"\bdocker\b", r"\bterraform\b"]
INDIAN_COMPANIES = ["tcs", "tata consultancy", "infosys", "wipro", "hcl", "tech mahindra", "cognizant", "mindtree", "mphasis", "ltimindtree", "lti", "persistent", "zoho", "freshworks", "flipkart", "paytm", "ola", "swiggy", "zomato", "byju", "razorpay", "phonepe", "cred", "meesho", "inmobi", "mu sigma", "capgemini india", "accenture india", "genpact", "cyient", "hexaware", "birlasoft", "niit", "sonata", "mastek", "zensar"]
INDIAN_CITIES = ["gurgaon", "gurugram", "bangalore", "bengaluru", "mumbai", "pune", "hyderabad", "chennai", "noida", "delhi", "kolkata", "ahmedabad", "jaipur", "chandigarh", "indore", "kochi", "coimbatore", "thiruvananthapuram", "lucknow", "bhopal", "nagpur", "visakhapatnam", "vadodara", "surat", "mohali", "thane", "navi mumbai", "whitefield", "electronic city", "hitech city", "gachibowli", "madhapur", "kondapur", "marathahalli"]
INDIAN_STATES = ["karnataka", "maharashtra", "tamil nadu", "telangana", "andhra pradesh", "kerala", "gujarat", "rajasthan", "uttar pradesh", "delhi ncr", "ncr", "haryana", "punjab", "west bengal", "madhya pradesh"]
TECH = {
    "AWS": [r"\baws\b", r"\bamazon web services\b"],
    "GCP": [r"\bgcp\b", r"\bgoogle cloud\b"],
    "Azure": [r"\bazure\b", r"\bmicrosoft azure\b"],
    "Kubernetes": [r"\bkubernetes\b", r"\bk8s\b"],
    "Docker": [r"\bdocker\b", r"\bcontainers?\b"],
    "Terraform": [r"\bterraform\b", r"\biac\b", r"\binfrastructure as code\b"],
    "CI/CD": [r"\bci/?cd\b", r"\bjenkins\b", r"\bgithub actions\b", r"\bgitlab ci\b", r"\bargo\s*cd\b"],
    "Python": [r"\bpython\b"],
    "Go": [r"\bgolang\b", r"\bgo\b"],
    "Linux": [r"\blinux\b", r"\bunix\b"],
    "Ansible": [r"\bansible\b"],
    "Prometheus": [r"\bprometheus\b", r"\bgrafana\b", r"\bobservability\b"],
    "Helm": [r"\bhelm\b"],
    "Pulumi": [r"\bpulumi\b"],
    "CloudFormation": [r"\bcloudformation\b"],
    "JavaScript": [r"\bjavascript\b", r"\bjs\b"],
    "TypeScript": [r"\btypescript\b", r"\bts\b"],
    "React": [r"\breact\b", r"\breactjs\b"],
    "Vue": [r"\bvue\b", r"\bvuejs\b"],
    "Angular": [r"\bangular\b"],
    "Node.js": [r"\bnode\.?js\b", r"\bnodejs\b"],
    "Java": [r"\bjava\b"],
    "Spring": [r"\bspring\b", r"\bspring boot\b"],
    "C#": [r"\bc#\b", r"\bcsharp\b"],
    ".NET": [r"\.net\b"],
    "PHP": [r"\bphp\b"],
    "Ruby": [r"\bruby\b", r"\brails\b"],
    "Swift": [r"\bswift\b"],
    "Kotlin": [r"\bkotlin\b"],
    "Rust": [r"\brust\b"],
    "SQL": [r"\bsql\b", r"\bpostgresql\b", r"\bmysql\b"],
    "MongoDB": [r"\bmongodb\b", r"\bmongo\b"],
    "Redis": [r"\bredis\b"],
    "GraphQL": [r"\bgraphql\b"],
    "REST": [r"\brest\b", r"\brestful\b"],
    "Git": [r"\bgit\b"],
    "Agile": [r"\bagile\b", r"\bscrum\b"],
    "DevOps": [r"\bdevops\b"],
    "Machine Learning": [r"\bml\b", r"\bmachine learning\b", r"\bai\b"],
    "Data Science": [r"\bdata science\b"],
    "Blockchain": [r"\bblockchain\b", r"\bweb3\b"],
    "Mobile": [r"\bmobile\b", r"\bios\b", r"\bandroid\b"],
    "Security": [r"\bsecurity\b", r"\bcybersecurity\b"],
}
ENTERPRISES = [r"\bgoogle\b", r"\bamazon\b", r"\bmeta\b", r"\bmicrosoft\b", r"\bapple\b", r"\bnetflix\b", r"\bspotify\b", r"\bstripe\b", r"\buber\b", r"\bairbnb\b", r"\bsalesforce\b"]
STARTUPS = [r"\bstartup\b", r"\bseed\b", r"\bseries a\b"]
FAKE = [r"\btelegram\b", r"\bwhatsapp\b", r"\bskype\b", r"\bdiscord\b.*\binterview\b", r"\bcrypto\b.*\bjob\b", r"\bbitcoin\b.*\bjob\b", r"\binvestment\b.*\bopportunity\b", r"\bwork from home\b.*\bdaily payment\b", r"\bno experience\b.*\bhigh salary\b", r"\bearn\b.*\bdaily\b", r"\bquick money\b", r"\beasy money\b", r"\bclick\b.*\bearn\b", r"\bsurvey\b.*\bjob\b", r"\bdata entry\b.*\bcaptcha\b", r"\bcopy paste\b.*\bjob\b", r"\bform filling\b.*\bjob\b", r"\bad posting\b.*\bjob\b", r"\bsocial media\b.*\bposting\b", r"\btelegram\b.*\bchannel\b", r"\bjoin\b.*\btelegram\b", r"\bmessage\b.*\btelegram\b", r"\bcontact\b.*\btelegram\b", r"\bwhatapp\b", r"\bwhats app\b"]
SUSPICIOUS = [r"\binc\b.*\bnew\b", r"\bstartup\b.*\bhiring\b.*\bimmediately\b", r"\burgent\b.*\bhiring\b", r"\bimmediate\b.*\bjoin\b", r"\bno interview\b", r"\bno resume\b", r"\bno qualification\b"]
URGENT = r"\burgent\b|\bimmediate\b|\basap\b|\btoday\b"
VERIFIED_REMOTE = [r"\b100%\s*remote\b", r"\bfully remote\b", r"\bremote\s*-\s*global\b", r"\bremote\s*worldwide\b", r"\bwork from anywhere\b", r"\banywhere in the world\b", r"\bglobal remote\b", r"\bno location restriction\b", r"\blocation independent\b"]
NOT_REMOTE = [r"\bhybrid\b", r"\bon-site\b", r"\bonsite\b", r"\bon site\b", r"\bin-office\b", r"\bin office\b", r"\bus only\b", r"\busa only\b", r"\bunited states only\b", r"\beu only\b", r"\beurope only\b", r"\buk only\b", r"\bcanada only\b"]
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "remote", "job", "position", "role", "opening", "hiring", "needed"]
TITLE_FORMS = [("sr ", "senior "), ("sr.", "senior "), ("jr ", "junior "), ("jr.", "junior "), ("dev ", "developer "), ("eng ", "engineer "), ("devops", "devops "), ("ml ", "machine learning "), ("ai ", "artificial intelligence "), ("qa ", "quality assurance "), ("pm ", "product manager "), ("fullstack", "full stack"), ("full-stack", "full stack")]
COMPANY_SUFFIXES = ["inc.", "inc", "ltd.", "ltd", "llc", "corp.", "corp", "gmbh", "ag", "sa", "pty", "co.", "co", "plc", "bv"]
TRUST = {"greenhouse": 10.0, "lever": 10.0, "ashby": 10.0, "workable": 10.0, "wellfound": 9.0, "indie_hackers": 9.5, "yc_jobs": 9.0, "github_jobs": 9.0, "devto_jobs": 9.0, "authentic_jobs": 8.5, "product_hunt": 8.0, "weworkremotely": 7.5, "remotive": 6.5, "arbeitnow": 6.0, "stackoverflow": 7.0, "hashnode": 7.5, "remoteok": 5.0, "working_nomads": 4.5, "himalayas": 4.0, "jobicy": 4.0, "jobspresso": 4.5}
TRUST_UNKNOWN = 3.0
RANK_WEIGHTS = {"source_trust": 0.20, "freshness": 0.25, "quality": 0.20, "company": 0.15, "remote_authenticity": 0.10, "salary_quality": 0.10}
RELEVANCE_WEIGHTS = {"title": 0.3, "description": 0.25, "experience": 0.2, "seniority": 0.1, "location": 0.1, "freshness": 0.05, "quality": 0.1}
SPAM_PHRASES = ["bitcoin", "crypto", "forex", "mlm", "pyramid", "guarantee", "guaranteed", "no experience needed", "work from anywhere instantly"]
BOARD_DOMAINS = ["linkedin.com", "indeed.com", "glassdoor.com", "remotive.com", "remoteok.io", "weworkremotely.com", "github.com/jobs", "dev.to", "angel.co", "wellfound.com"]
COMMON_TECH = ["python", "javascript", "typescript", "react", "node", "aws", "docker", "kubernetes", "sql", "git", "java", "go", "rust"]
SENIORITY_STEPS = {"intern": 0, "junior": 1, "mid_level": 2, "senior": 3, "staff": 4, "principal": 5, "lead": 5, "manager": 6, "director": 7, "vp": 8, "executive": 9}
QUERY_STOP_WORDS = ["engineer", "developer", "remote", "job", "jobs", "role", "roles"]
WORLDWIDE = [r"\bworldwide\b", r"\bglobal(?:ly)?\s+(?:team|company|hiring|remote|position)\b", r"\banywhere\b", r"\bwork\s+from\s+anywhere\b", r"\b100%\s*remote\b", r"\bfully\s+remote\b", r"\bremote\s+first\b", r"\bremote\s+-\s+global\b", r"\bno\s+location\s+(?:restriction|requirement|limit)\b", r"\bopen\s+to\s+(?:all|everyone|global)\b", r"\binternational\s+(?:team|hiring|remote)\b"]
HIRES_IN_INDIA = [r"\bindia\b", r"\bindian\s+(?:applicants?|candidates?|developers?|engineers?|professionals?)\b", r"\bhiring\s+(?:from|in)\s+india\b", r"\basia\s+(?:pac(?:ific)?|timezone)\b", r"\b(?:ist|gmt\s*\+5:?30)\b", r"\b(?:bangalore|bengaluru|mumbai|pune|hyderabad|chennai|delhi|gurgaon|noida)\b"]
LOCAL_ONLY = [r"\bin\s+our\s+(?:office|headquarters?|location)\b", r"\bhybrid\s+(?:work|model|mode)\b", r"\bonsite\b", r"\b(?:must|required)\s+to\s+(?:be\s+)?(?:based|located)\s+in\b", r"\b(?:poland|warsaw|krakow|wrocław|poznań|gdańsk|gdynia|sopot|katowice|łódź|szczecin|lublin|bydgoszcz|toruń|bieńsko|rzeszów|częstochowa|radom|zielona|gorzów|opole|elbląg|płock|wałbrzych|tarnów|kielce|kalisk|gliwice|zabrze|bielsko|bytom|rybnik|ruda|tychy|dąbrowa|chorzów|jastrzębie|jelenia|nowy|sącz|siedlce|konin|piotrków|inowrocław|ostrołęka|suwałki|stargard|gniezno|leszno|przemyśl|łomża|łowicz|oświęcim|świdnica|chełm|skierniewice|starachowice|kołobrzeg|tomaszów|krotoszyn|jarosław|nowa|sól|jasło|dębica|zawiercie|międzyrzecz|aleksandrów|łuków|sandomierz|hajnówka|sejny|lidzbark|bartoszyce|ełk|giżycko|węgorzewo|olecko|pisz|mrągowo|nidzica|działdowo|nowe|miasto|lubawa|iława|ostróda|morąg|pasłęk|braniewo|gołdap)\b"]
ZONES = r"\b(?:gmt|utc)\s*[+-]\d{1,2}"
SUSPICIOUS_NAMES = [r"test\s+company", r"example\s+corp", r"dummy\s+inc", r"unknown", r"anon(?:ymous)?", r"sample\s+firm", r"temp\s+agency"]
LEGITIMATE_SIGNALS = [r"\b(?:apply|application|requirement|qualification|responsibilit)", r"\b(?:email|resume|cv|portfolio|github|linkedin)\b", r"\b(?:experience|skill|technology|stack|tool)\b", r"\b(?:benefit|salary|compensation|equity|stock)\b", r"\b(?:team|culture|mission|vision|value)\b"]
AUTH_CHALLENGES = [r"sign\s*in", r"log\s*in", r"login", r"signin", r"authenticate", r"captcha", r"recaptcha", r"hcaptcha", r"turnstile", r"challenge", r"access denied", r"accessdenied", r"blocked", r"too many requests", r"rate.li", r"cf-ray", r"cf-browser-verification", r"just a moment", r"checking your browser", r"verifying you are human", r"are you a robot", r"please verify", r"_cf_challenge", r"robot.or.human"]
ADAPTER_SPAM = ["bitcoin", "crypto", "forex", "mlm", "pyramid", "guarantee", "no experience needed"]
SENIORITY_PATTERNS = [("intern", r"\bintern\b|\btrainee\b|\bapprentice\b"), ("junior", r"\bjunior\b|\bentry[\s-]?level\b|\bgraduate\b|\bnew grad\b"), ("senior", r"\bsenior\b|\bsr\.?\b|staff|\bprincipal\b"), ("lead", r"\blead\b|\bhead of\b"), ("manager", r"\bmanager\b"), ("director", r"\bdirector\b"), ("vp", r"\bvp\b|\bvice president\b"), ("executive", r"\bexecutive\b|\bcto\b|\bceo\b|\bcfo\b")]
FAKE_SIGNALS = [r"earn \$?\d+k?/?(?:day|week)", r"no experience needed.*(?:high|great) pay", r"work from home.*\$?\d+k", r"click here to apply", r"apply.*now.*limited", r"bit\.ly|tinyurl|shortlink", r"make money fast", r"immediate start.*no experience", r"unlimited earning potential", r"be your own boss", r"copy and paste"]
JOB_TYPES = {"full-time": "full_time", "full time": "full_time", "part-time": "part_time", "part time": "part_time", "contract": "contract", "internship": "internship", "freelance": "freelance", "temporary": "temporary"}
CERTIFICATES = ["aws certified", "aws solutions architect", "aws developer", "aws sysops", "azure certified", "azure administrator", "azure developer", "gcp certified", "google cloud certified", "pmp", "project management professional", "scrum master", "csm", "cspo", "agile certified", "ccna", "ccnp", "ccie", "cisco", "cissp", "ceh", "security+", "google cloud professional", "microsoft certified", "oracle certified", "salesforce certified", "kubernetes certified", "cka", "ckad", "docker certified", "red hat certified", "tableau certified", "power bi certified"]
CV_YEARS = [r"(\d+(?:\.\d+)?)\+?\s*years?\s*(?:of\s*)?(?:experience|work|professional\s*experience)", r"(\d+(?:\.\d+)?)\s*years?\s*(?:of\s*)?(?:total\s*)?experience", r"experience\s*:\s*(\d+(?:\.\d+)?)\+?\s*years?", r"total\s*experience\s*:\s*(\d+(?:\.\d+)?)\+?\s*years?", r"(\d+(?:\.\d+)?)\s*years?\s*of\s*professional\s*experience"]
QUERY_ROLES = {
    "devops": "devops", "sre": "devops", "site reliability": "devops", "platform engineer": "devops", "infrastructure": "devops", "cloud engineer": "devops",
    "backend": "backend", "back-end": "backend", "back end": "backend",
    "frontend": "frontend", "front-end": "frontend", "front end": "frontend",
    "full stack": "fullstack", "fullstack": "fullstack", "full-stack": "fullstack",
    "data": "data", "data science": "data", "ml": "data", "machine learning": "data", "ai": "data",
    "mobile": "mobile", "ios": "mobile", "android": "mobile",
    "security": "security",
    "qa": "qa", "quality assurance": "qa", "test": "qa",
}
COUNTRIES = r"\b(?:usa|uk|germany|france|spain|portugal|netherlands|sweden|norway|denmark|finland|czech|australia|japan|singapore|brazil|canada|mexico|argentina|chile|colombia)\b"
KNOWN_COMPANIES = [
    "google", "amazon", "meta", "microsoft", "apple", "netflix", "spotify", "stripe", "datadog", "cloudflare", "gitlab", "hashicorp", "docker", "vercel", "netlify", "supabase", "railway", "fly.io", "render",
    "digitalocean", "linode", "mongodb", "elastic", "grafana", "prometheus", "snyk", "palantir", "red hat", "ibm", "oracle", "salesforce", "twitter/x", "shopify", "github", "figma", "notion", "linear", "retool", "airtable",
    "zapier", "intercom", "hubspot", "atlassian", "twilio", "sendgrid", "confluent", "databricks", "snowflake", "cockroach labs", "neon", "planetscale", "cockroachdb", "motherduck", "dagster", "airbyte",
    "temporal", "hasura", "appwrite", "liveblocks", "magic", "workos", "clerk", "plaid", "brex", "ramp", "deel", "remote", "multi", "safetywing", "borderless", "omni",
    "automattic", "buffer", "vox media", "verizon media", "zillow", "reddit", "discord", "twitch", "youtube", "medium", "substack", "ghost", "revenuecat", "paddle", "lemonsqueezy", "stax",
    "segment", "amplitude", "mixpanel", "heap", "hotjar", "fullstory", "clickhouse", "materialize", "risingwave", "tidb", "dgraph", "neo4j", "redis", "memcached", "nats", "eventstore", "apache",
    "cncf", "linux foundation", "cloud native", "alibaba", "tencent", "baidu", "bytedance", "tiktok", "alibaba cloud", "huawei", "samsung", "lg", "naver", "kakao", "coupang", "grab", "gojek",
    "traveloka", "bukalapak", "tokopedia", "shopee", "lazada",
]
BLOCKED_HOSTS = ["linkedin.com", "glassdoor.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "indeed.com/viewjob"]
CLUSTER_PRIORITY = {"greenhouse": 10, "github_jobs": 9, "devto_jobs": 9, "wellfound": 8, "authentic_jobs": 8, "indie_hackers": 8, "weworkremotely": 7, "remotive": 5, "remoteok": 4, "rss_feeds": 3}
BOARD_SUFFIXES = [" LinkedIn Board", " LinkedIn", " Board", " Careers"]
TITLE_BREAKS = [" | ", " - ", " – ", " · ", " — ", " : "]
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY", "AUD": "AUD", "CAD": "CAD"}
PAY_PERIODS = [("hourly", ["hour", "hr"]), ("monthly", ["month", "mo"]), ("yearly", ["year", "yr", "annually"])]
PAY_RANGES = [r"[\$€£₹¥]?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*[-–to]\s*[\$€£₹¥]?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)", r"(\d{1,3})k?\s*[-–to]\s*(\d{1,3})k?", r"(\d{5,7})\s*[-–to]\s*(\d{5,7})"]
PAY_SINGLE = r"[\$€£₹¥]?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*k?"
PAY_IN_TEXT = [r"[\$€£]\s*[\d,]+(?:k|K)?(?:\s*[-–to]+\s*[\$€£]?\s*[\d,]+(?:k|K)?)?", r"\d[\d,]*\s*[-–to]+\s*\d[\d,]*\s*(?:USD|EUR|GBP)?"]
PLACE_TYPES = [("remote", ["remote", "wfh", "work from home", "telecommute"]), ("hybrid", ["hybrid", "flexible"]), ("onsite", ["onsite", "on-site", "office"])]
PLACE_COUNTRIES = ["united states", "usa", "us", "united kingdom", "uk", "canada", "australia", "germany", "france", "india", "netherlands", "spain"]
DEGREES = [r"(bachelor|master|phd|doctorate|b\.s\.|m\.s\.|b\.a\.|m\.a\.|b\.tech|m\.tech|b\.e|m\.e)", r"(computer science|software engineering|information technology|data science|computer engineering)", r"(mba|mca|bca|b\.com|m\.com)"]
EDUCATION_OPENS = ["education", "academic", "university", "college", "qualification"]
EDUCATION_CLOSES = ["experience", "work", "skills", "projects"]
FORM_FIELDS = {
    "firstname": ["firstname", "first name", "givenname", "forename"],
    "lastname": ["lastname", "last name", "surname", "familyname"],
    "email": ["email", "e-mail", "mail"],
    "phone": ["phone", "telephone", "mobile", "phonenumber", "cell", "contactnumber"],
    "linkedinurl": ["linkedin", "linked in"],
    "githuburl": ["github", "git hub"],
    "portfoliourl": ["portfolio", "portfolio url"],
    "website": ["website", "personal website", "homepage", "url"],
    "city": ["city", "town"],
    "state": ["state", "province", "region"],
    "country": ["country", "nation"],
    "postalcode": ["postalcode", "postal code", "zip", "zipcode"],
    "headline": ["headline", "professional title", "current title"],
    "professionalsummary": ["summary", "professionalsummary", "bio", "about me", "professional summary"],
    "company": ["company", "employer", "organization", "current company", "current employer"],
    "jobtitle": ["position", "job title", "role", "title", "job position", "jobtitle"],
    "explocation": ["location", "where located", "located", "where are you located", "work location", "job location"],
    "startdate": ["start date", "startdate", "from", "start"],
    "enddate": ["end date", "enddate", "to", "end", "finish"],
    "school": ["school", "university", "college", "institution", "educational institution"],
    "degree": ["degree", "qualification", "education level", "education"],
    "gpa": ["gpa", "grade point average", "grade point", "overall result"],
}
# End of fixed values.

#: Common words by which a text counts as English where no language is stated; this library's choice.
ENGLISH_WORDS = ["the", "of", "and", "a", "to", "in", "is", "for", "that", "with", "on", "as", "are", "be", "you", "we", "our", "will", "or", "by", "this", "at", "from", "have", "it"]
