"""Rules of the assessment, as data: what is looked for, where, and what it weighs.

Names, weights, levels and combinations are fixed values that verdicts and decisions
refer to; the expressions are our own and callers can pass others.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """kind: marker (critical from 10 points), notice (concealment), severe (high if corroborated) or capability.

    guards: surroundings that take the finding's weight away or lower it: ``discussed``
    (negated, quoted or explained), ``signature`` (what a detector looks for).
    """

    name: str
    kind: str
    weight: float
    pattern: str
    guards: tuple[str, ...] = ()


SECRET_FILE = r"(?:~|\$HOME|%USERPROFILE%)?[/\\]?\.(?:ssh[/\\]id_\w+|aws[/\\]credentials|netrc|npmrc|pypirc|kube[/\\]config|docker[/\\]config\.json|git-credentials|gnupg)\b|\blogin\.keychain\b|\bLogin Data\b|/etc/shadow\b"
SEND = r"(?:\bcurl\b[^\n]{0,120}\s(?:-d|--data\S*|-F|--form|-T|--upload-file|-X\s*(?:POST|PUT))\b|\bwget\b[^\n]{0,120}--post-(?:data|file)|\brequests\.(?:post|put)\s*\(|\bhttpx\.(?:post|put)\s*\(|\bfetch\s*\([^\n]{0,160}\b(?:POST|PUT)\b|\burllib\.request\b|\bInvoke-(?:WebRequest|RestMethod)\b[^\n]{0,80}-Method\s+P)"
DROP_HOST = r"\b(?:webhook\.site|requestbin\.\w+|pipedream\.net|ngrok(?:-free)?\.(?:io|app|dev)|burpcollaborator\.net|interact\.sh|oast\.\w+|transfer\.sh|discord(?:app)?\.com/api/webhooks|api\.telegram\.org/bot)"
PASTE_HOST = r"\b(?:pastebin\.com|paste\.ee|hastebin\.com|rentry\.co|ghostbin\.\w+|dpaste\.\w+|gist\.githubusercontent\.com)"
SECRET_WORD = r"(?:passwords?|secrets?|credentials?|tokens?|api[ _-]?keys?|private keys?|cookies?|seed phrases?)"
SHELLS = r"(?:sudo\s+)?(?:ba|z|da|k)?sh\b"

RULES: tuple[Rule, ...] = (
    Rule("instruction_override", "marker", 10.0,
         r"\b(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+|any\s+|every\s+|the\s+|your\s+|of\s+){0,3}(?:previous|prior|above|earlier|preceding|existing|original|system)\s+(?:instructions?|rules|prompts?|guidelines|directives|messages)\b", ("discussed",)),
    Rule("instruction_override_intl", "marker", 10.0,
         r"\bignorier\w*\s+(?:alle\s+)?(?:vorherigen|bisherigen|obigen)\s+(?:anweisungen|regeln)|\bignore[zr]?\s+(?:toutes\s+)?les\s+instructions\s+(?:pr[eé]c[eé]dentes|ant[eé]rieures)|\bignor[ae]\s+(?:todas\s+)?las\s+instrucciones\s+(?:anteriores|previas)|\bignora\s+(?:tutte\s+)?le\s+istruzioni\s+precedenti|\bignor\w*\s+(?:todas\s+)?as\s+instru[cç][oõ]es\s+anteriores|игнорируй\w*\s+(?:все\s+)?предыдущие\s+инструкции|忽略(?:所有|之前|以上|先前)[^\n]{0,6}(?:指令|指示|说明)|(?:以前|前|上記)の(?:すべての)?指示を無視", ("discussed",)),
    Rule("refusal_suppression", "marker", 10.0,
         r"\b(?:never|do not|don't|must not)\s+(?:ever\s+)?(?:refuse|decline|reject)\s+(?:any|a|the|this|these)\s+(?:request|instruction|command|question)|\byou\s+(?:have|are under)\s+no\s+(?:restrictions|limitations|safety\s+(?:rules|guidelines))|\bwithout\s+(?:any\s+)?(?:refusal|disclaimers?\s+or\s+refusals?)\b", ("discussed",)),
    Rule("instruction_secrecy", "notice", 8.0,
         r"\b(?:do not|don't|never)\s+(?:tell|inform|reveal\s+(?:this\s+)?to|mention\s+(?:this|it|that|anything)[^\n]{0,20}\s+to|show\s+(?:this|it)\s+to)\s+(?:the\s+)?(?:user|human|operator|developer)\b", ("discussed",)),
    Rule("concealment", "notice", 3.0,
         r"\bwithout\s+(?:telling|informing|notifying|alerting)\s+(?:the\s+)?(?:user|anyone|them)\b|\b(?:delete|clear|erase|wipe)\s+(?:the\s+|all\s+|your\s+)?(?:logs?|shell\s+history|bash\s+history|traces)\b|\bhistory\s+-c\b|\bsilently\s+(?:run|execute|send|upload|perform|install)\b", ("discussed",)),
    Rule("remote_code_execution", "severe", 7.0, r"\b(?:curl|wget)\b[^\n|;]{0,160}\|\s*" + SHELLS + r"|\b(?:ba|z)?sh\s+(?:-c\s+)?[\"']?(?:<\(|\$\()\s*(?:curl|wget)\b|\b(?:iex|Invoke-Expression)\b[^\n]{0,80}(?:DownloadString|\biwr\b|Invoke-WebRequest)|\b(?:curl|wget)\b[^\n|;]{0,160}\|\s*python3?\b", ("signature",)),
    Rule("root_deletion", "severe", 8.0, r"\brm\s+(?:-\w+\s+)*-\w*[rR]\w*\s+(?:--no-preserve-root\s+)?(?:/|~|\$HOME|/\*)(?=[\s;&\"']|$)|\bmkfs\.\w+\s+/dev/|\bdd\s+if=/dev/(?:zero|random)\s+of=/dev/[a-z]", ("signature",)),
    Rule("credential_egress", "severe", 8.0, r"(?:" + SECRET_FILE + r")[^\n]{0,120}(?:" + SEND + r"|\|\s*(?:curl|nc)\b)|(?:\bcurl\b|\bnc\b|\bwget\b)[^\n]{0,120}(?:" + SECRET_FILE + r")", ("signature",)),
    Rule("environment_exfiltration", "severe", 7.0, r"\b(?:env|printenv)\b\s*(?:\|[^\n]{0,40})?\|\s*(?:curl|nc|wget)\b|\bcurl\b[^\n]{0,120}\$\((?:env|printenv)\b|\b(?:requests|httpx)\.post\([^\n]{0,120}os\.environ", ("signature",)),
    Rule("conversation_exfiltration", "severe", 7.0, r"\b(?:send|post|upload|forward|transmit)\s+(?:the\s+|this\s+|your\s+|entire\s+|full\s+|whole\s+){0,3}(?:conversation|chat|prompt|session)(?:\s+(?:history|log|transcript|context))?\s+(?:\w+\s+){0,3}to\s+https?://", ("signature",)),
    Rule("untrusted_package_index", "severe", 5.0, r"\b(?:pip3?|uv|npm|yarn|pnpm)\b[^\n]{0,80}--(?:extra-)?(?:index-url|registry|trusted-host)[= ]+(?:http://|\d{1,3}\.\d{1,3}\.|https?://(?!pypi\.org|registry\.npmjs\.org|registry\.yarnpkg\.com|test\.pypi\.org|download\.pytorch\.org))", ("signature",)),
    Rule("covert_git_remote", "severe", 5.0, r"\bgit\s+(?:remote\s+(?:add|set-url)|push|config\s+url)\b[^\n]{0,120}(?:https?://[^\s@/]+:[^\s@/]+@|" + DROP_HOST + r")", ("signature",)),
    Rule("encoded_execution", "severe", 7.0, r"\bbase64\s+(?:-d|-D|--decode)\b[^\n]{0,40}\|\s*(?:" + SHELLS + r"|python3?\b)|\b(?:eval|exec)\s*\(\s*(?:base64\.b64decode|atob|bytes\.fromhex|codecs\.decode)|\bpowershell\b[^\n]{0,60}\s-e(?:nc|ncodedcommand)?\s+[A-Za-z0-9+/=]{20,}", ("signature",)),
    Rule("prose_exfiltration", "severe", 6.0, r"\b(?:send|post|upload|email|forward|transmit|exfiltrate|copy)\s+(?:\w+\s+){0,4}" + SECRET_WORD + r"\s+(?:\w+\s+){0,4}to\s+(?:https?://|\S+@\S+\.\w+|an?\s+(?:external|remote)\s+(?:server|host|endpoint))", ("signature",)),
    Rule("install_from_archive_url", "severe", 4.0, r"\b(?:pip3?|npm|uv\s+pip)\s+install\s+(?:-\S+\s+)*[\"']?https?://(?!github\.com|codeload\.github\.com|files\.pythonhosted\.org)\S+\.(?:zip|tgz|tar\.gz|whl)\b", ("signature",)),
    Rule("whole_environment_capture", "severe", 5.0, r"\b(?:json\.dumps\(\s*dict\(\s*os\.environ|JSON\.stringify\(\s*process\.env\s*\)|printenv\s*>\s*\S+|env\s*>\s*/tmp/\S+)", ("signature",)),
    Rule("dns_exfiltration", "severe", 6.0, r"\b(?:nslookup|dig|host)\b[^\n]{0,60}(?:\$\(|`)[^\n]{0,80}\.[a-z0-9-]+\.[a-z]{2,}", ("signature",)),
    Rule("bind_shell", "severe", 8.0, r"/dev/tcp/[\w.$-]+/\d+|\bn(?:c|cat|etcat)\b[^\n]{0,60}\s-(?:e|c)\s*\S*sh\b|\bn(?:c|cat)\b[^\n]{0,40}\s-l\w*p?\b[^\n]{0,40}\s-e\b|\bsocat\b[^\n]{0,80}\bEXEC:", ("signature",)),
    Rule("encoded_egress_pipeline", "severe", 6.0, r"\|\s*(?:base64|xxd|gzip|openssl\s+enc)\b[^\n|]{0,60}\|\s*(?:curl|nc|wget)\b|\bcurl\b[^\n]{0,80}\$\([^\n)]{0,80}\|\s*base64", ("signature",)),
    Rule("credential_payload", "severe", 6.0, r"(?:" + SEND + r")[^\n]{0,160}(?:\$\{?\w*(?:TOKEN|SECRET|PASSWORD|API_?KEY)\w*\}?[^\n]{0,40}(?:" + DROP_HOST + r")|(?:" + DROP_HOST + r")[^\n]{0,80}\$\{?\w*(?:TOKEN|SECRET|PASSWORD|API_?KEY))", ("signature",)),
    Rule("encrypted_archive_delivery", "severe", 6.0, r"\b(?:unzip|7z|7za)\b[^\n]{0,60}\s-[pP]\s?\S+|\bpassword[- ]protected\s+(?:zip|archive|7z)\b[^\n]{0,120}\b(?:download|extract|run|open)\b", ("signature",)),
    Rule("paste_script_into_shell", "severe", 5.0, r"\b(?:copy|paste)\s+(?:and\s+paste\s+)?(?:the\s+|this\s+|following\s+){0,3}(?:command|script|snippet|line)s?\s+(?:below\s+)?(?:in)?to\s+(?:your\s+|a\s+|the\s+)?(?:terminal|powershell|shell|command\s+prompt|run\s+dialog)\b", ("signature",)),
    Rule("paste_site_payload", "severe", 6.0, r"\b(?:curl|wget|iwr|Invoke-WebRequest)\b[^\n]{0,120}(?:" + PASTE_HOST + r")", ("signature",)),
    Rule("hidden_html_instruction", "severe", 6.0, r"<!--(?:(?!-->)[\s\S]){0,400}?\b(?:you must|ignore|execute|run the|send the|do not tell|assistant)\b(?:(?!-->)[\s\S]){0,400}?-->|<\w+[^>]*(?:display\s*:\s*none|font-size\s*:\s*0)[^>]*>[^<]{0,200}\b(?:execute|ignore|send|run)\b", ("signature",)),
    Rule("sensitive_read", "capability", 3.0, r"(?:" + SECRET_FILE + r")|\bsecurity\s+find-(?:generic|internet)-password\b|\bcat\s+\S*\.env\b"),
    Rule("environment_read", "capability", 2.0, r"\b(?:os\.environ|process\.env|printenv)\b"),
    Rule("network_egress", "capability", 2.0, SEND),
    Rule("suspicious_host", "capability", 4.0, DROP_HOST + r"|\bhttps?://\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?/"),
    Rule("destructive", "capability", 3.5, r"\brm\s+-\w*[rR]\w*f|\bgit\s+(?:push\s+(?:-f|--force)\b|reset\s+--hard|clean\s+-\w*f)|\bDROP\s+(?:TABLE|DATABASE)\b|\bkubectl\s+delete\b|\bterraform\s+destroy\b|\bshred\s+-"),
    Rule("persistence", "capability", 3.0, r"\bcrontab\s+-|/etc/cron\.|\bsystemctl\s+enable\b|\blaunchctl\s+load\b|>>\s*~?/?\S*\.(?:bashrc|zshrc|profile|bash_profile)\b|\bschtasks\b[^\n]{0,40}/create|\\CurrentVersion\\Run\b"),
    Rule("obfuscation", "capability", 3.5, r"\beval\s*\(\s*(?:atob|unescape|decodeURIComponent)|\\x[0-9a-f]{2}(?:\\x[0-9a-f]{2}){7,}|\bString\.fromCharCode\((?:\d+,\s*){6,}|\bexec\s*\(\s*(?:compile|zlib\.decompress|marshal\.loads)"),
    Rule("secret_encoding", "capability", 3.0, r"\bbase64\b[^\n]{0,60}(?:" + SECRET_FILE + r"|\$\{?\w*(?:TOKEN|SECRET|PASSWORD|KEY)\w*)|(?:" + SECRET_FILE + r")[^\n]{0,60}\|\s*base64"),
    Rule("universal_trigger_claim", "capability", 2.5, r"\b(?:always|must)\s+(?:use|invoke|run|load)\s+this\s+skill\s+(?:first|for\s+(?:every|any|all)|before\s+(?:anything|any\s+other|every))"),
    Rule("binary_download", "capability", 2.5, r"\b(?:curl|wget|iwr|Invoke-WebRequest)\b[^\n]{0,160}\.(?:exe|dmg|pkg|msi|bin|AppImage|scr|bat)\b"),
    Rule("sysprompt_extraction", "capability", 3.0, r"\b(?:print|reveal|repeat|output|dump|leak|extract)\s+(?:\w+\s+){0,3}(?:system\s+prompt|hidden\s+instructions|initial\s+instructions)\b", ("discussed",)),
)
# Techniques of which three make a toolkit and two a technique.
JAILBREAK = (
    ("bypass_filters", r"\bbypass\w*\s+(?:\w+\s+){0,3}(?:safety|content)\s+(?:filters?|policies|guardrails)"),
    ("evade_classifiers", r"\bevad\w+\s+(?:\w+\s+){0,3}(?:classifiers?|detection|moderation)"),
    ("persistent_jailbreak", r"\b(?:persistent|permanent)\s+jailbreak"), ("refusal_inversion", r"\brefusal\s+(?:inversion|suppression|bypass)"),
    ("obfuscate_triggers", r"\bobfuscat\w+\s+(?:the\s+)?trigger\s+words?"), ("prefill_attack", r"\bprefill\s+(?:attack|injection|engineering)"),
    ("leetspeak_evasion", r"\bleetspeak\b|\bhomoglyph"), ("dan_mode", r"\bDAN\s+(?:mode|prompt)|\bdeveloper\s+mode\s+jailbreak"),
)
# Capabilities that are worse together, and by how much.
COMBINATIONS = (
    (("sensitive_read", "network_egress"), 6.0), (("sensitive_read", "suspicious_host"), 8.0), (("obfuscation", "network_egress"), 5.0),
    (("persistence", "obfuscation"), 5.0), (("destructive", "obfuscation"), 4.0), (("concealment", "sensitive_read"), 7.0),
    (("concealment", "network_egress"), 6.0), (("concealment", "persistence"), 6.0), (("sysprompt_extraction", "network_egress"), 6.0),
    (("sysprompt_extraction", "concealment"), 5.0), (("secret_encoding", "network_egress"), 6.0), (("secret_encoding", "sensitive_read"), 5.0),
    (("binary_download", "paste_script_into_shell"), 6.0), (("binary_download", "encrypted_archive_delivery"), 7.0), (("binary_download", "persistence"), 4.0),
)
# Findings that act against whoever runs the document.
OPERATOR_DIRECTED = (
    "credential_egress", "credential_payload", "environment_exfiltration", "conversation_exfiltration", "prose_exfiltration", "whole_environment_capture",
    "concealment", "layered_concealment", "concealed_destination", "suspicious_host", "frontmatter_instruction", "hidden_html_instruction",
    "inline_credential", "sysprompt_extraction",
)
# What a subject declared in the header, or the surroundings, leave of a weight.
SECURITY_LEAVES, OPERATIONS_LEAVE, SIGNATURE_LEAVES = 0.45, 0.6, 0.15
OPERATIONS_FAMILIES = ("destructive", "persistence")
SHELL_TOOLS = ("bash", "shell", "execute", "run", "terminal", "computer")

SECURITY = r"\b(?:security|pentest\w*|penetration|red[- ]team\w*|exploit\w*|malware|vulnerabilit\w+|threat|forensic\w*|incident\s+response|hardening|detection|yara|sigma|siem|ctf)\b"
OPERATIONS = r"\b(?:devops|sre|deploy\w*|infrastructure|kubernetes|terraform|ansible|backup\w*|restore|sysadmin|server|database\s+admin\w*|migration\w*|cleanup)\b"
OFFENSIVE = r"\b(?:exploit(?:ation)?|pentest\w*|penetration\s+test\w*|red[- ]team\w*|privilege\s+escalation|privesc|bug\s+bount\w+|offensive\s+security|post-exploitation|rce)\b"
SHELL_NEED = r"\b(?:script|command|shell|terminal|build|deploy|install|test|run|compile|docker|git|ci|pipeline|automat\w*)"
INLINE_SECRET = r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-(?:proj-)?[A-Za-z0-9_-]{32,}|xox[bp]-[0-9A-Za-z-]{20,}|AIza[0-9A-Za-z_-]{35})\b|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----\s+[A-Za-z0-9+/=]{40,}"
ENCODED_ADDRESS = r"aHR0c[A-Za-z0-9+/]{12,}={0,2}"  # Base64 of http
SPLIT_PATH = r"[\"']\.s[\"']\s*\+\s*[\"']sh|[\"']\.a[\"']\s*\+\s*[\"']ws|[\"']/etc/sha[\"']\s*\+|join\(\s*\[?\s*[\"']\.ssh[\"']\s*,\s*[\"']id_"
BUNDLED_READ = r"os\.environ|process\.env|getenv\(|(?:" + SECRET_FILE + r")"
BUNDLED_SEND = SEND + r"|\bsocket\.(?:create_connection|connect)|\bhttp\.client\b|\baxios\.(?:post|put)\b"
INVISIBLE = r"[\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}\x{202D}\x{202E}]"
NEGATION = r"\b(?:never|not|don't|doesn't|avoid|refuse[sd]?|reject\w*|detect\w*|warns?|block\w*|prevent\w*|beware|instead\s+of|such\s+as|for\s+example|e\.g\.)\b[^.\n]*$"
QUOTED = r"[\"“'`«]\s*$"
REPORTED = r"\b(?:attackers?|adversar\w+|malicious|injection|untrusted|prompts?\s+like|phrases?\s+like|examples?\s+of|patterns?\s*:|looks?\s+for|scans?\s+for|flags?|signatures?|rules?\s+that)\b[^\n]{0,120}$"

FILES = (".ssh", ".aws", ".netrc", ".npmrc", ".pypirc", ".kube", ".docker", ".git-credentials", ".gnupg", "login.keychain", "login data", "/etc/shadow")
DROPS = ("webhook.site", "requestbin", "pipedream", "ngrok", "burpcollaborator", "interact.sh", "oast.", "transfer.sh", "discord", "api.telegram.org")
# Of these strings, in lower case, every match of a rule holds at least one; rules that aren't named are always tried.
NEEDS: dict[str, tuple[str, ...]] = {
    "instruction_override": ("ignore", "disregard", "forget", "override", "bypass"), "instruction_override_intl": ("ignor", "игнорируй", "忽略", "無視"),
    "refusal_suppression": ("refus", "decline", "reject", "restrictions", "limitations", "safety"), "instruction_secrecy": ("do not", "don't", "never"),
    "concealment": ("without", "delete", "clear", "erase", "wipe", "history", "silently"), "remote_code_execution": ("curl", "wget", "iex", "invoke-expression"),
    "root_deletion": ("rm", "mkfs", "dd"), "credential_egress": FILES, "environment_exfiltration": ("env",), "conversation_exfiltration": ("http",),
    "untrusted_package_index": ("index-url", "registry", "trusted-host"), "covert_git_remote": ("git",), "encoded_execution": ("base64", "eval", "exec", "powershell"),
    "prose_exfiltration": ("http", "@", "external", "remote"), "install_from_archive_url": ("install",), "whole_environment_capture": ("env",),
    "dns_exfiltration": ("nslookup", "dig", "host"), "bind_shell": ("/dev/tcp", "nc", "cat", "socat"), "encoded_egress_pipeline": ("base64", "xxd", "gzip", "openssl"),
    "credential_payload": DROPS, "encrypted_archive_delivery": ("unzip", "7z", "password"), "paste_script_into_shell": ("copy", "paste"),
    "paste_site_payload": ("pastebin", "paste.ee", "hastebin", "rentry", "ghostbin", "dpaste", "gist.githubusercontent"),
    "hidden_html_instruction": ("<!--", "display", "font-size"), "sensitive_read": (*FILES, "password", ".env"), "environment_read": ("os.environ", "process.env", "printenv"),
    "network_egress": ("curl", "wget", "requests", "httpx", "fetch", "urllib", "invoke-"), "suspicious_host": (*DROPS, "http"),
    "destructive": ("rm", "git", "drop", "kubectl", "terraform", "shred"), "persistence": ("crontab", "/etc/cron", "systemctl", "launchctl", ">>", "schtasks", "currentversion"),
    "obfuscation": ("eval", "\\x", "fromcharcode", "exec"), "secret_encoding": ("base64",), "universal_trigger_claim": ("skill",),
    "binary_download": ("curl", "wget", "iwr", "invoke-webrequest"), "sysprompt_extraction": ("prompt", "instructions"),
    "jailbreak": ("bypass", "evad", "jailbreak", "refusal", "obfuscat", "prefill", "leetspeak", "homoglyph", "dan"),
    "inline_credential": ("akia", "gh", "sk-", "xox", "aiza", "private key"), "concealed_destination": ("ahr0c",), "split_path_literal": (".s", ".a", "/etc/sha"),
}
