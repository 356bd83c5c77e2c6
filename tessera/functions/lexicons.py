"""Word lists, tables and patterns that decide results."""

# They must be these for right results.
SYNONYMS = {
    "bug": ["issue", "problem", "error", "defect", "fault"],
    "fix": ["repair", "resolve", "patch", "solution", "correction"],
    "code": ["source", "program", "script", "implementation"],
    "function": ["method", "procedure", "routine", "operation"],
    "variable": ["parameter", "argument", "value", "field"],
    "database": ["db", "datastore", "storage", "repository"],
    "api": ["interface", "endpoint", "service", "REST"],
    "test": ["check", "verify", "validate", "QA", "testing"],
    "deploy": ["release", "publish", "launch", "rollout"],
    "config": ["configuration", "settings", "preferences", "setup"],
    "doc": ["documentation", "docs", "manual", "guide"],
    "auth": ["authentication", "authorization", "login", "security"],
    "user": ["customer", "client", "person", "account"],
    "log": ["logging", "logs", "trace", "debug", "record"],
    "error": ["exception", "failure", "crash", "fault"],
    "performance": ["speed", "efficiency", "optimization", "perf"],
    "cache": ["caching", "buffer", "store", "memory"],
    "search": ["query", "find", "lookup", "retrieve"],
    "index": ["indexing", "catalog", "directory"],
    "async": ["asynchronous", "concurrent", "parallel", "non-blocking"],
}
# Fixed values.
ABBREVIATIONS = {
    "db": "database",
    "api": "application programming interface",
    "ui": "user interface",
    "ux": "user experience",
    "qa": "quality assurance",
    "ci": "continuous integration",
    "cd": "continuous deployment",
    "ml": "machine learning",
    "ai": "artificial intelligence",
    "nlp": "natural language processing",
    "rag": "retrieval augmented generation",
    "llm": "large language model",
    "gpu": "graphics processing unit",
    "cpu": "central processing unit",
    "ram": "random access memory",
    "ssd": "solid state drive",
    "http": "hypertext transfer protocol",
    "sql": "structured query language",
    "json": "javascript object notation",
    "xml": "extensible markup language",
    "csv": "comma separated values",
    "pdf": "portable document format",
    "env": "environment",
    "config": "configuration",
    "auth": "authentication",
    "admin": "administrator",
    "dev": "development",
    "prod": "production",
    "perf": "performance",
}
# Fixed values.
VARIATIONS = {
    "running": ["run", "runs", "ran", "runner"],
    "writing": ["write", "writes", "wrote", "written", "writer"],
    "reading": ["read", "reads", "reader"],
    "processing": ["process", "processes", "processed", "processor"],
    "indexing": ["index", "indexes", "indexed", "indexer"],
    "searching": ["search", "searches", "searched", "searcher"],
    "caching": ["cache", "caches", "cached"],
    "testing": ["test", "tests", "tested", "tester"],
    "debugging": ["debug", "debugs", "debugged", "debugger"],
    "deploying": ["deploy", "deploys", "deployed", "deployment"],
}
# Fixed values.
TYPOS = {
    "databse": "database",
    "fucntion": "function",
    "vairable": "variable",
    "authentification": "authentication",
    "authorisation": "authorization",
    "deployement": "deployment",
    "configuraiton": "configuration",
    "documetnation": "documentation",
    "performace": "performance",
    "asyncronous": "asynchronous",
    "indxing": "indexing",
    "serach": "search",
    "cahce": "cache",
    "errir": "error",
    "debig": "debug",
    "tets": "test",
    "pyton": "python",
    "javascrpt": "javascript",
    "typscript": "typescript",
}
# Follow-up questions.
PRONOUNS = ["it", "its", "that", "this", "these", "those", "them", "they", "their"]
FOLLOW_UPS = [
    r"^(what|how|why|when|where|who) about",
    r"^(tell|show|explain|describe) (me )?more",
    r"^(and|also|but|however)",
    r"^(can|could|would|should) (you|it|that)",
]
NOT_TOPICS = [
    "what", "when", "where", "how", "why", "which", "about", "with", "from", "that", "this", "these",
    "those", "have", "been", "were", "will", "would", "could", "should", "does", "doing", "done",
]
# Questions about the index.
META_WORDS = ["files?", "documents?", "files", "documents", "index?", "index"]
META_PATTERNS = [
    "what.*indexed", "what.*have", "what.*you.*got", "show.*file", "show.*document", "list.*file", "list.*document",
    "available.*file", "available.*document", "indexed.*file", "indexed.*document", "what file", "which file",
    "what document", "which document", "tell me.*file", "tell me.*document", "tell me.*index", "want.*see.*document",
    "want.*see.*file", "display.*file", "display.*document",
]
META_COUNT, META_STATS = ["how many", "number", "count", "total"], ["statistic", "summary", "overview"]
META_KEYWORDS = {
    "count": ["how many", "number of", "count", "total"],
    "list": ["what documents", "which documents", "list all", "show all", "what files", "which files", "indexed documents", "available documents"],
    "stats": ["statistics", "summary", "overview", "index info"],
}
# Document types by file name, and hints in queries.
NAME_RULES = {
    "meeting": ["meeting", "minutes", "standup", "retro", "retrospective"],
    "prd": ["prd", "requirement", "spec", "specification"],
    "wiki": ["wiki", "guide", "manual", "howto", "how-to"],
}
QUERY_HINTS = {
    "meeting": ["meeting", "standup", "retro", "retrospective", "minutes"],
    "prd": ["prd", "product requirement", "specification", "spec"],
    "technical": ["technical", "architecture", "implementation", "code", "api"],
    "wiki": ["wiki", "documentation", "guide", "manual"],
}
HINT_KEYWORDS = {"meeting": ["meeting", "agenda", "discussion"], "prd": ["requirement", "product", "feature"]}
RECENT = ["last", "latest", "recent", "newest"]
FOCUSED = ["specific", "exact", "particular"]
VISUAL = ["image", "chart", "graph", "diagram", "figure", "picture", "visual", "table", "plot", "illustration"]
# Chunk size and overlap by document type, and factors by language.
CHUNK_PARAMS = {"meeting": (800, 100), "prd": (1500, 300), "technical": (1800, 400), "wiki": (1200, 250), "general": (1200, 200)}
LANGUAGE_FACTORS = {"cjk": (0.7, 0.8), "mixed": (0.85, 1.0)}
# Context sizes by model.
MODEL_CONTEXTS = {
    "gpt-4": 8192,
    "gpt-4-32k": 32768,
    "gpt-3.5-turbo": 4096,
    "gpt-3.5-turbo-16k": 16384,
    "claude-2": 100000,
    "claude-instant": 100000,
    "llama-2-7b": 4096,
    "llama-2-13b": 4096,
    "llama-2-70b": 4096,
    "mistral-7b": 8192,
    "gpt-oss:20b": 4096,
    "embeddinggemma:300m": 2048,
}
# Words that are no keywords of a conversation.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they", "my", "your", "his", "her", "its", "our", "their", "me", "him",
    "us", "them",
]
# File suffixes that can be indexed.
SUFFIXES = [
    ".pdf", ".txt", ".text", ".md", ".markdown", ".docx", ".doc", ".html", ".htm", ".csv", ".xlsx", ".xls", ".json", ".xml",
    ".yml", ".yaml", ".log", ".rtf",
]
