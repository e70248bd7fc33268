"""Fixed values the results depend on.

Word lists, lookup tables, thresholds, message texts and detection regexes are
inputs to the analytics, not logic.  They live here together, as plain text and
in their natural order, so every operator and every check reads the same copy.
"""

# --- fixed values: severities, best to worst rank --------------------------------
SEVERITY_ORDER = ["critical", "high", "medium", "low", "info"]
DEFAULT_SEVERITY = "medium"

# --- fixed values: languages ------------------------------------------------------
SUPPORTED_LANGUAGES = ["python", "javascript", "java", "php", "c", "cpp"]

SCAN_EXTENSIONS = [".py", ".js", ".java", ".php", ".c", ".cpp", ".h", ".hpp"]

EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "javascript",
    ".tsx": "javascript",
    ".java": "java",
    ".php": "php",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".hxx": "cpp",
}

SUFFIX_LANGUAGE = [
    (".py", "python"),
    (".js", "javascript"),
    (".java", "java"),
    (".php", "php"),
    (".c", "c"),
    (".cpp", "cpp"),
]

SUFFIX_DISPLAY_NAME = [
    (".py", "Python"),
    (".js", "JavaScript"),
    (".java", "Java"),
    (".php", "PHP"),
    (".c", "C/C++"),
    (".cpp", "C/C++"),
]

CONTENT_SIGNATURES = {
    "python": ["def ", "import ", "from ", "class ", "__init__"],
    "javascript": ["function", "const ", "let ", "var ", "=>", "require("],
    "java": ["public class", "private ", "protected ", "package ", "import java"],
    "php": ["<?php", "namespace ", "use ", "function ", "$"],
    "c": ["#include <", "int main(", "void ", "struct ", "typedef"],
    "cpp": ["#include <", "using namespace", "class ", "template<", "::"],
}

HASH_COMMENT_LANGUAGES = ["python"]
SLASH_COMMENT_LANGUAGES = ["javascript", "java", "c", "cpp"]
COMMENT_STARTS = ["//", "#", "/*", "*"]

# --- fixed values: rule knowledge base --------------------------------------------
RULES = [
    {
        "rule_id": "SQL-001",
        "name": "SQL Injection",
        "description": "User input directly concatenated into SQL queries without parameterization",
        "severity": "critical",
        "cwe_id": "CWE-89",
        "owasp": "A03:2021",
        "languages": ["python", "javascript", "java", "php"],
        "threshold": 0.7,
        "false_positive_rate": 0.1,
        "fix": "Use parameterized queries or prepared statements. Never concatenate user input into SQL.",
        "alternatives": {
            "python": "cursor.execute('SELECT * FROM users WHERE id = ?', (user_id,))",
            "javascript": "db.query('SELECT * FROM users WHERE id = ?', [userId])",
            "java": "PreparedStatement ps = conn.prepareStatement('SELECT * FROM users WHERE id = ?')",
        },
        "reference": "https://owasp.org/www-community/attacks/SQL_Injection",
    },
    {
        "rule_id": "XSS-001",
        "name": "Cross-Site Scripting (XSS)",
        "description": "User input rendered in HTML without proper escaping",
        "severity": "high",
        "cwe_id": "CWE-79",
        "owasp": "A03:2021",
        "languages": ["javascript", "php", "python"],
        "threshold": 0.7,
        "false_positive_rate": 0.15,
        "fix": "Always escape user input before rendering. Use textContent instead of innerHTML.",
        "alternatives": {
            "javascript": "element.textContent = userInput;",
            "php": "echo htmlspecialchars($_GET['input'], ENT_QUOTES, 'UTF-8');",
            "python": "{{ user_input | e }} in Jinja2 templates",
        },
        "reference": "https://owasp.org/www-community/attacks/xss/",
    },
    {
        "rule_id": "CMD-001",
        "name": "Command Injection",
        "description": "System commands executed with user-controlled input",
        "severity": "critical",
        "cwe_id": "CWE-78",
        "owasp": "A03:2021",
        "languages": ["python", "javascript", "java", "php", "c"],
        "threshold": 0.7,
        "false_positive_rate": 0.1,
        "fix": "Avoid system calls with user input. Use language-specific libraries instead of shell commands.",
        "alternatives": {
            "python": "subprocess.run(['command', 'arg'], shell=False, check=True)",
            "javascript": "const { spawn } = require('child_process'); spawn('command', ['arg']);",
            "java": "ProcessBuilder pb = new ProcessBuilder('command', 'arg');",
        },
        "reference": "https://owasp.org/www-community/attacks/Command_Injection",
    },
    {
        "rule_id": "DESER-001",
        "name": "Insecure Deserialization",
        "description": "Deserializing untrusted data can lead to remote code execution",
        "severity": "critical",
        "cwe_id": "CWE-502",
        "owasp": "A08:2021",
        "languages": ["python", "java", "php"],
        "threshold": 0.7,
        "false_positive_rate": 0.05,
        "fix": "Never deserialize untrusted data. Use JSON or other safe formats.",
        "alternatives": {
            "python": "json.loads(data) # Use JSON instead of pickle",
            "java": "Use JSON with Jackson or Gson instead of Java serialization",
            "php": "json_decode($data) // Use JSON instead of unserialize",
        },
        "reference": "https://owasp.org/www-community/vulnerabilities/Deserialization_of_untrusted_data",
    },
    {
        "rule_id": "PATH-001",
        "name": "Path Traversal",
        "description": "File access with user-controlled paths enabling directory traversal",
        "severity": "high",
        "cwe_id": "CWE-22",
        "owasp": "A01:2021",
        "languages": ["python", "javascript", "java", "php"],
        "threshold": 0.7,
        "false_positive_rate": 0.2,
        "fix": "Validate and sanitize file paths. Use allow-lists for accessible directories.",
        "alternatives": {
            "python": "safe_path = os.path.join(SAFE_DIR, os.path.basename(user_input))",
            "javascript": "const safePath = path.join(SAFE_DIR, path.basename(userInput));",
            "java": "Path safe = Paths.get(SAFE_DIR).resolve(Paths.get(userInput).getFileName());",
        },
        "reference": "https://owasp.org/www-community/attacks/Path_Traversal",
    },
    {
        "rule_id": "OSYS-001",
        "name": "Unsafe os.system usage",
        "description": "os.system is unsafe for executing system commands",
        "severity": "high",
        "cwe_id": "CWE-78",
        "owasp": "A03:2021",
        "languages": ["python"],
        "threshold": 0.6,
        "false_positive_rate": 0.1,
        "fix": "Use the subprocess module instead of os.system, and ensure that user-input is properly sanitized and escaped.",
        "alternatives": {
            "python": "subprocess.run(['command', 'arg'], shell=False, check=True)",
        },
        "reference": "https://docs.python.org/3/library/subprocess.html#security-considerations",
    },
    {
        "rule_id": "EXEC-001",
        "name": "Unsafe exec usage",
        "description": "exec() can execute arbitrary Python code",
        "severity": "high",
        "cwe_id": "CWE-94",
        "owasp": "A03:2021",
        "languages": ["python"],
        "threshold": 0.8,
        "false_positive_rate": 0.05,
        "fix": "Avoid using exec(). If necessary, strictly validate input or use ast.literal_eval for safe evaluation.",
        "alternatives": {
            "python": "# Avoid exec() entirely, or use ast.literal_eval() for data",
        },
        "reference": "https://docs.python.org/3/library/functions.html#exec",
    },
    {
        "rule_id": "EVAL-001",
        "name": "Unsafe eval usage",
        "description": "eval() can execute arbitrary code",
        "severity": "high",
        "cwe_id": "CWE-94",
        "owasp": "A03:2021",
        "languages": ["python", "javascript"],
        "threshold": 0.8,
        "false_positive_rate": 0.05,
        "fix": "Use ast.literal_eval() for Python or JSON.parse() for JavaScript",
        "alternatives": {
            "python": "ast.literal_eval(data) # Safe evaluation of literals",
            "javascript": "JSON.parse(data) // Safe JSON parsing",
        },
        "reference": "https://developer.mozilla.org/en-US/docs/Web/JavaScript/Reference/Global_Objects/eval#never_use_eval!",
    },
]

# one row per detection regex: (rule, language, regex)
RULE_REGEXES = [
    ("SQL-001", "python", r'query\s*=\s*["\'][^"\']*\+'),
    ("SQL-001", "python", r'sql\s*=\s*["\'][^"\']*\+'),
    ("SQL-001", "python", r'execute\s*\(["\'][^"\']*\+'),
    ("SQL-001", "python", r'execute\s*\(.*?\+.*?\)'),
    ("SQL-001", "python", r'execute\s*\(f["\']'),
    ("SQL-001", "python", r'(SELECT|INSERT|UPDATE|DELETE)[^"\']*["\'\s]\s*\+'),
    ("SQL-001", "python", r'["\']SELECT.*WHERE.*["\'\s]\s*\+'),
    ("SQL-001", "javascript", r'query\s*\(["\'][^"\']*\+'),
    ("SQL-001", "javascript", r'execute\s*\(["\'][^"\']*\$\{'),
    ("SQL-001", "javascript", r'raw\s*\(["\'][^"\']*\$\{'),
    ("SQL-001", "java", r'createQuery\s*\(["\'][^"\']*\+'),
    ("SQL-001", "java", r'executeQuery\s*\(["\'][^"\']*\+'),
    ("SQL-001", "php", r'mysql_query\s*\(["\'][^"\']*\.\s*\$'),
    ("SQL-001", "php", r'mysqli_query\s*\([^,]*,\s*["\'][^"\']*\.\s*\$'),
    ("XSS-001", "javascript", r'innerHTML\s*='),
    ("XSS-001", "javascript", r'outerHTML\s*='),
    ("XSS-001", "javascript", r'document\.write\s*\('),
    ("XSS-001", "javascript", r'document\.writeln\s*\('),
    ("XSS-001", "javascript", r'insertAdjacentHTML\s*\('),
    ("XSS-001", "javascript", r'dangerouslySetInnerHTML'),
    ("XSS-001", "php", r'echo\s+.*\$_(?:GET|POST|REQUEST)'),
    ("XSS-001", "php", r'print\s+.*\$_(?:GET|POST|REQUEST)'),
    ("XSS-001", "python", r'render_template_string\s*\(.*request\.'),
    ("XSS-001", "python", r'Markup\s*\(.*request\.'),
    ("CMD-001", "python", r'os\.system\s*\([^)]*\+'),
    ("CMD-001", "python", r"os\.system\s*\(f['\"]"),
    ("CMD-001", "python", r'os\.system\s*\([^)]*%'),
    ("CMD-001", "python", r'subprocess\.call\s*\([^)]*shell\s*=\s*True'),
    ("CMD-001", "python", r'subprocess\.run\s*\([^)]*shell\s*=\s*True'),
    ("CMD-001", "python", r'os\.popen\s*\('),
    ("CMD-001", "javascript", r'child_process\.exec\s*\('),
    ("CMD-001", "javascript", r'child_process\.execSync\s*\('),
    ("CMD-001", "javascript", r'child_process\.spawn\s*\([^)]*shell.*true'),
    ("CMD-001", "java", r'Runtime\.getRuntime\(\)\.exec\s*\('),
    ("CMD-001", "java", r'ProcessBuilder\s*\([^)]*\+'),
    ("CMD-001", "php", r'system\s*\('),
    ("CMD-001", "php", r'exec\s*\('),
    ("CMD-001", "php", r'shell_exec\s*\('),
    ("CMD-001", "php", r'passthru\s*\('),
    ("CMD-001", "php", r'`[^`]*\$'),
    ("CMD-001", "c", r'system\s*\('),
    ("CMD-001", "c", r'popen\s*\('),
    ("DESER-001", "python", r'pickle\.loads\s*\('),
    ("DESER-001", "python", r'pickle\.load\s*\('),
    ("DESER-001", "python", r'yaml\.load\s*\([^)]*Loader\s*=\s*yaml\.Loader'),
    ("DESER-001", "python", r'yaml\.load\s*\([^)]*[^)]$'),
    ("DESER-001", "python", r'\beval\s*\('),
    ("DESER-001", "python", r'\bexec\s*\('),
    ("DESER-001", "java", r'ObjectInputStream'),
    ("DESER-001", "java", r'readObject\s*\('),
    ("DESER-001", "java", r'XMLDecoder'),
    ("DESER-001", "php", r'unserialize\s*\('),
    ("DESER-001", "php", r'\beval\s*\('),
    ("PATH-001", "python", r'open\s*\([^)]*request\.'),
    ("PATH-001", "python", r'open\s*\([^)]*\+'),
    ("PATH-001", "python", r'os\.path\.join\s*\([^)]*request\.'),
    ("PATH-001", "python", r'pathlib\.Path\s*\([^)]*\+'),
    ("PATH-001", "javascript", r'readFile\s*\([^)]*req\.'),
    ("PATH-001", "javascript", r'createReadStream\s*\([^)]*req\.'),
    ("PATH-001", "javascript", r'readFileSync\s*\([^)]*\+'),
    ("PATH-001", "java", r'new\s+File\s*\([^)]*request\.get'),
    ("PATH-001", "java", r'Paths\.get\s*\([^)]*request\.get'),
    ("PATH-001", "php", r'include\s*\([^)]*\$_(?:GET|POST)'),
    ("PATH-001", "php", r'require\s*\([^)]*\$_(?:GET|POST)'),
    ("PATH-001", "php", r'file_get_contents\s*\([^)]*\$_'),
    ("OSYS-001", "python", r'os\.system\s*\('),
    ("EXEC-001", "python", r'\bexec\s*\('),
    ("EVAL-001", "python", r'\beval\s*\('),
    ("EVAL-001", "javascript", r'\beval\s*\('),
]

# what a rule with an invalid regex degrades to:
# (marker in the regex, needs a word boundary marker, rule id, name, description, cwe, fix, regex)
FALLBACK_CONFIDENCE = 0.9
FALLBACK_SEVERITY = "high"
FALLBACK_RULES = [
    ("os.system", False, "OSYS-001", "Unsafe os.system usage",
     "os.system is unsafe for executing system commands", "CWE-78",
     "Use subprocess.run with shell=False instead", r"os\.system\s*\("),
    ("eval", True, "EVAL-001", "Unsafe eval usage",
     "eval() can execute arbitrary code", "CWE-94",
     "Use ast.literal_eval() or JSON.parse() instead", r"\beval\s*\("),
    ("exec", True, "EXEC-001", "Unsafe exec usage",
     "exec() can execute arbitrary Python code", "CWE-94",
     "Avoid exec() or strictly validate input", r"\bexec\s*\("),
]

# --- fixed values: keyword scan: (language, keyword, risk) ------------------------
KEYWORD_RISKS = [
    ("python", "eval", "Code injection risk"),
    ("python", "exec", "Code injection risk"),
    ("python", "os.system", "Command injection risk"),
    ("python", "subprocess.call", "Command injection risk if shell=True"),
    ("python", "pickle.loads", "Deserialization vulnerability"),
    ("python", "__import__", "Dynamic import security risk"),
    ("javascript", "eval", "Code injection risk"),
    ("javascript", "innerHTML", "XSS vulnerability risk"),
    ("javascript", "document.write", "DOM XSS risk"),
    ("javascript", "setTimeout", "Potential code injection if string passed"),
    ("javascript", "dangerouslySetInnerHTML", "React XSS risk"),
    ("java", "Runtime.exec", "Command injection risk"),
    ("java", "ProcessBuilder", "Command injection risk"),
    ("java", "ObjectInputStream", "Deserialization vulnerability"),
    ("java", "ScriptEngine", "Code injection risk"),
    ("php", "eval", "Code injection risk"),
    ("php", "system", "Command injection risk"),
    ("php", "exec", "Command injection risk"),
    ("php", "unserialize", "Deserialization vulnerability"),
    ("php", "include", "File inclusion vulnerability if dynamic"),
    ("c", "gets", "Buffer overflow risk"),
    ("c", "strcpy", "Buffer overflow risk"),
    ("c", "sprintf", "Format string vulnerability"),
    ("c", "system", "Command injection risk"),
    ("cpp", "gets", "Buffer overflow risk"),
    ("cpp", "strcpy", "Buffer overflow risk"),
    ("cpp", "sprintf", "Format string vulnerability"),
    ("cpp", "system", "Command injection risk"),
]
KEYWORD_CONFIDENCE = 0.85
KEYWORD_CWE = {
    "eval": "CWE-95",
    "exec": "CWE-78",
    "innerHTML": "CWE-79",
    "system": "CWE-78",
    "execute": "CWE-89",
    "SELECT": "CWE-89",
}
KEYWORD_FIX = {
    "eval": "Use ast.literal_eval() for Python or JSON.parse() for JavaScript",
    "exec": "Avoid dynamic code execution. Use predefined functions instead",
    "innerHTML": "Use textContent or sanitize input with DOMPurify",
    "strcpy": "Use strncpy() or snprintf() with bounds checking",
    "gets": "Use fgets() with buffer size limit",
    "system": "Use subprocess with shell=False or execve() family functions",
    "execute": "Use parameterized queries instead of string concatenation",
    "SELECT": "Use parameterized queries to prevent SQL injection",
}
UNKNOWN_CWE = "CWE-Unknown"
DEFAULT_KEYWORD_FIX = "Review and sanitize all user inputs"
COMPLEXITY_LIMIT = 10
COMPLEXITY_FIX = "Consider breaking this function into smaller, more focused functions"
BLOCK_DECISION_WORDS = ["if", "while", "for", "switch", "case", "catch"]

# --- fixed values: vulnerability types --------------------------------------------
TYPE_CWE = {
    "SQL Injection": "CWE-89",
    "XSS": "CWE-79",
    "Command Injection": "CWE-78",
    "Path Traversal": "CWE-22",
    "Insecure Deserialization": "CWE-502",
}
TYPE_FIX = {
    "SQL Injection": "Use parameterized queries or prepared statements. Never concatenate user input into SQL.",
    "XSS": "Sanitize all user input before rendering. Use textContent instead of innerHTML.",
    "Command Injection": "Avoid system calls with user input. Use subprocess with shell=False.",
    "Path Traversal": "Validate and sanitize file paths. Use os.path.basename() and check against whitelist.",
    "Insecure Deserialization": "Never deserialize untrusted data. Use JSON instead of pickle/serialize.",
}
DEFAULT_TYPE_FIX = "Review and sanitize all user inputs."
CRITICAL_TYPES = ["SQL Injection", "Command Injection", "Insecure Deserialization"]
HIGH_TYPES = ["XSS", "Path Traversal"]
TYPE_LINE_KEYWORDS = {
    "SQL Injection": ["SELECT", "INSERT", "UPDATE", "DELETE", "query", "execute"],
    "XSS": ["innerHTML", "document.write", "html(", "append("],
    "Command Injection": ["system", "exec", "subprocess", "shell"],
    "Path Traversal": ["open(", "readFile", "include", "require"],
    "Insecure Deserialization": ["pickle", "unserialize", "loads", "json.loads"],
}
TYPE_KEYS = [
    ("SQL Injection", "sql_injection"),
    ("Cross-Site Scripting", "xss"),
    ("Command Injection", "command_injection"),
]
CWE_TYPE = {
    "CWE-89": "SQL Injection",
    "CWE-79": "XSS",
    "CWE-78": "Command Injection",
    "CWE-22": "Path Traversal",
    "CWE-502": "Insecure Deserialization",
    "CWE-94": "Code Injection",
    "CWE-190": "Buffer Overflow",
    "CWE-476": "NULL Pointer Dereference",
    "CWE-415": "Double Free",
    "CWE-120": "Buffer Copy without Checking",
}
CWE_CLASS = {
    "CWE-120": 0,
    "CWE-89": 1,
    "CWE-78": 2,
    "CWE-134": 3,
    "CWE-476": 4,
    "CWE-415": 5,
    "CWE-401": 6,
    "CWE-190": 7,
    "CWE-22": 8,
}
OTHER_CLASS = 9

# --- fixed values: code segmentation ----------------------------------------------
BLOCK_STARTS = ["def ", "function ", "public ", "private "]
SUSPICIOUS_SEGMENTS = [
    (r"(\w+)\s*=.*\n.*\1", "data_flow"),
    (r"(eval|exec|system).*\n.*(request|input|user)", "dangerous_combo"),
    (r"getattr.*\(.*,.*request", "reflection"),
    (r"__import__.*\(.*\+", "dynamic_import"),
    (r"pickle.*loads.*request", "unsafe_protocol"),
]

# --- fixed values: labelled data --------------------------------------------------
LABELLED_LINE_LITERALS = ["strcpy", "sprintf", "gets", "system(", "exec(", "eval(", "mysql_query", "executeQuery"]
LABELLED_LINE_REGEX = r"String.*\+.*String"
COMPLEXITY_WORDS = ["if", "else", "while", "for", "switch", "case", "?", "&&", "||"]
VARIANT_RENAMES = [
    ("buffer", "buf"),
    ("query", "sql"),
    ("command", "cmd"),
    ("filename", "file"),
    ("username", "user"),
    ("password", "pass"),
    ("input", "data"),
]

# --- fixed values: context word lists ---------------------------------------------
CONTEXT_INPUT_WORDS = ["request", "input", "user", "param", "arg"]
CONTEXT_VALIDATION_WORDS = ["validate", "sanitize", "escape", "filter", "check"]
CONTEXT_ERROR_WORDS = ["try:", "except:", "catch", "finally:"]
FEATURE_INPUT_WORDS = ["input", "request", "user", "param"]
FEATURE_VALIDATION_WORDS = ["validate", "sanitize", "escape", "check"]
DANGEROUS_WORDS = ["eval", "exec", "system", "shell"]
SQL_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE"]
TEST_PATH_MARKS = ["test_", "_test.", "/tests/", "\\tests\\"]
SECURITY_FUNCTION_WORDS = ["sanitize", "validate", "escape", "filter"]

# --- fixed values: confidence scoring ---------------------------------------------
METHOD_WEIGHTS = {"pattern": 0.7, "ast": 0.8, "codebert": 0.9, "gnn": 0.85, "hybrid": 0.95}
OTHER_METHOD_WEIGHT = 0.5
AI_METHODS = ["codebert", "gnn", "hybrid"]
FACTOR_WEIGHTS = {"base": 0.4, "context": 0.2, "historical": 0.15, "complexity": 0.1, "validation": 0.15}
CONTEXT_MODIFIERS = {"test_file": -0.3, "comment": -0.5, "user_input": 0.2, "validation": -0.3, "security_function": -0.2}
DEFAULT_TYPE_ACCURACY = 0.75
DEFAULT_METHOD_ACCURACY = 0.75

# --- fixed values: anomaly ladders ------------------------------------------------
RISK_WORDS = [
    ("CRITICAL", ["eval", "exec", "pickle.loads", "__import__"]),
    ("HIGH", ["system", "subprocess", "os.", "request."]),
    ("MEDIUM", ["open(", "file", "path"]),
]
RISK_TEXT = "Potential security-sensitive operations"
LOW_RISK_TEXT = "LOW: No immediate security indicators"
CWE_WORDS = [
    ("CWE-89", ["sql", "query"]),
    ("CWE-94", ["eval", "exec"]),
    ("CWE-78", ["system", "subprocess"]),
    ("CWE-502", ["pickle", "marshal"]),
    ("CWE-22", ["../", "..\\", "path"]),
]
SEGMENT_FLAG_WORDS = [
    ("has_danger", ["eval", "exec", "system"], True),
    ("has_sql", ["sql", "query"], True),
    ("has_input", ["request", "input"], True),
    ("has_secret", ["password", "secret"], True),
    ("has_protocol", ["pickle", "marshal", "yaml"], False),
]

# --- fixed values: code graph -----------------------------------------------------
NODE_TYPE_SLOTS = [
    "function_def", "class_def", "var_assign", "function_call", "control_flow",
    "parameter", "return", "import", "literal", "identifier", "operator",
    "condition", "loop", "exception", "comment", "declaration", "pointer",
    "array_access", "struct_access", "other",
]
NODE_PATTERN_WORDS = [
    ("buffer_overflow", ["strcpy", "sprintf", "gets", "strcat", "scanf"]),
    ("sql_injection", ["mysql_query", "executeQuery", "SELECT.*\\+", "INSERT.*\\+"]),
    ("command_injection", ["system", "exec", "popen", "Runtime.exec"]),
    ("format_string", ["printf.*%", "sprintf.*%", "fprintf.*%"]),
    ("null_pointer", ["malloc", "calloc", "free", "NULL"]),
    ("double_free", ["free", "delete"]),
    ("memory_leak", ["malloc", "new", "calloc"]),
    ("integer_overflow", ["\\+\\+", "--", "\\*", "\\+", "unsigned", "int"]),
]
NODE_SEMANTIC_WORDS = [
    ("security", ["password", "secret", "token", "auth", "login", "admin"]),
    ("network", ["socket", "connect", "send", "recv", "http", "url"]),
    ("file_ops", ["fopen", "fread", "fwrite", "open", "read", "write"]),
    ("crypto", ["encrypt", "decrypt", "hash", "cipher", "key", "random"]),
    ("validation", ["check", "validate", "verify", "sanitize", "escape"]),
    ("dangerous", ["eval", "exec", "system", "unsafe", "temp", "debug"]),
]
NODE_SECURITY_WORDS = [
    ("allocation", ["malloc", "calloc"]),
    ("deallocation", ["free", "delete"]),
    ("unsafe_string", ["strcpy", "strcat"]),
    ("unsafe_input", ["gets", "scanf"]),
    ("system_call", ["system", "exec"]),
    ("arithmetic", ["++", "--", "+=", "-="]),
    ("branch", ["if", "while"]),
    ("null_reference", ["NULL", "null"]),
]
NODE_TYPE_MODIFIERS = ["unsigned", "signed"]
NODE_FORMAT_MARKS = ["%d", "%s", "%x"]
NODE_PARAMETER_WORDS = ["argc", "argv", "param"]
NODE_GLOBAL_WORDS = ["global", "static"]
LINE_TYPE_WORDS = {
    "declaration": ["int ", "char ", "void ", "float ", "double "],
    "control_flow": ["if", "while", "for", "switch"],
    "function_call": ["printf", "scanf", "malloc", "free", "strcpy"],
    "potential_vulnerability": ["strcpy", "gets", "sprintf", "system"],
    "import": ["#include", "import"],
}
NODE_MEMORY_WORDS = ["malloc", "free", "new", "delete"]
NODE_INPUT_WORDS = ["scanf", "gets", "input", "argv"]
NODE_OUTPUT_WORDS = ["printf", "cout", "print"]
EDGE_SLOTS = ["ast_child", "data_flow", "control_flow", "call_flow", "memory_flow", "pointer_flow", "semantic", "vulnerability"]
ALLOC_WORDS = ["malloc", "calloc", "new"]
FREE_WORDS = ["free", "delete"]
VULNERABLE_PAIRS = [("malloc", "strcpy"), ("gets", "printf"), ("scanf", "system"), ("user", "system")]
INDICATOR_WORDS = ["strcpy", "gets", "sprintf", "scanf", "system", "exec", "malloc", "free", "printf.*%", "NULL"]
BLOCK_COUNT_WORDS = ["if ", "for ", "while ", "return "]

# --- fixed values: learned rules and feedback -------------------------------------
STATUSES = ["open", "confirmed", "false_positive", "fixed"]
FALSE_POSITIVE_PREFIX = "FALSE_POSITIVE_"
FEEDBACK_REASON_PREFIX = "User feedback: "
CLASSIFIER_WORDS = ["eval", "exec", "system", "SELECT", "innerHTML"]
LEARNED_RULE_FIX = "Review and fix this vulnerability pattern"

# --- fixed values: explanation lookups --------------------------------------------
EXPLANATION_FIELDS = [
    "severity_assessment", "detailed_explanation", "attack_scenario", "business_impact",
    "fix_recommendation", "secure_code_example",
]
FALLBACK_DETAIL = " vulnerability was detected. Groq API unavailable for detailed analysis."
FALLBACK_ATTACK = "An attacker could potentially exploit this vulnerability"
FALLBACK_IMPACT = "Could lead to security breach if exploited"
FALLBACK_RECOMMENDATION = "Review and fix the vulnerable code pattern"
FALLBACK_EXAMPLE = "// Fix implementation needed"
FALLBACK_REFERENCE = "https://cwe.mitre.org/"
PROMPT_OPENING = "You are an expert security researcher analyzing code vulnerabilities. \nAnalyze this "
PROMPT_REQUEST = "\n\nProvide a security analysis as a valid JSON object with exactly these fields:\n"
PROMPT_CLOSING = "\n\nIMPORTANT: Return ONLY valid JSON. No extra text. Ensure all strings are properly escaped."
PROMPT_FIELDS = {
    "severity_assessment": "Why this severity level is appropriate",
    "detailed_explanation": "Technical explanation of the vulnerability",
    "attack_scenario": "Realistic attack scenario",
    "business_impact": "Potential business impact",
    "fix_recommendation": "Specific actionable fix",
    "secure_code_example": "Corrected code example",
    "references": ["url1", "url2", "url3"],
}

# The text an explanation adds to a finding, and the mark that tells such a text.
ENRICHMENT_MARK = "Llama 3 70B"
ENRICHED_OPENING = "\n\n🤖 Advanced AI Analysis (Llama 3 70B):\n"
ENRICHED_ATTACK = "\n\n⚔️ Attack Vector: "
ENRICHED_RISK = "\n💼 Business Risk: "

#: Snippet of a structural finding without central lines.
NO_LOCATION = "[No specific location identified]"
GRAPH_SURE = "Graph Neural Network analysis detected structural patterns consistent with "
GRAPH_MAYBE = "Graph analysis detected structural patterns that might indicate "
GRAPH_TRAINED_NOTE = "The trained model identified suspicious code structure patterns."
GRAPH_UNTRAINED_NOTE = "Note: This detection uses an untrained model and may be less accurate."

#: Type names of patterns learned from false positives begin so.
FALSE_POSITIVE_PREFIX = "FALSE_POSITIVE_"
