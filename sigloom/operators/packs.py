"""Rule packs as data.  Fixed values throughout: needles, patterns, scores and techniques."""

from __future__ import annotations

# selection -> needles, any of which is a substring of the field, or behind `re:` a pattern found in it
PACKS: dict[str, dict[str, tuple[str, ...]]] = {
    "powershell_suspicious": {
        "execution": ("IEX", "Invoke-Expression", "-EncodedCommand", "-Exec Bypass", "Bypass"),
        "download": ("Invoke-WebRequest", "DownloadString", "DownloadFile", "WebClient"),
        "recon_identity": ("whoami", "hostname", "Get-LocalUser"),
        "recon_enum": ("net user", "net group", "ipconfig", "systeminfo", "Get-Process", "tasklist"),
    },
    "ps_scriptblock": {
        "encoded": ("-EncodedCommand", "-enc", "-ec"),
        "obfuscation": ("`", "[char]", "-join"),
        "iex": ("Invoke-Expression", "IEX("),
        "download": ("DownloadString", "Invoke-WebRequest", "Start-BitsTransfer"),
        "webclient": ("Net.WebClient", "HttpClient"),
        "amsi_bypass": ("amsiInitFailed", "AmsiScanBuffer", "AmsiUtils"),
        "exec_bypass": ("-ExecutionPolicy Bypass", "Set-ExecutionPolicy Unrestricted"),
        "recon_identity": ("whoami", "WindowsIdentity::GetCurrent()"),
        "recon_enum": ("net user", "Get-ADUser", "nltest"),
    },
    "ps_persistence": {
        "hidden": ("-WindowStyle Hidden", "-w hidden", "-NonInteractive"),
        "install": ("--install", "New-Service", "sc create"),
        "registry_run": ("CurrentVersion\\Run", "RunOnce"),
        "startup_folder": ("\\Start Menu\\Programs\\Startup", "SpecialFolder.Startup"),
        "schtask_inline": ("Register-ScheduledTask", "New-ScheduledTaskAction"),
        "wmi_subscription": ("__EventFilter", "CommandLineEventConsumer"),
    },
    "ps_privilege_escalation": {
        "local_admin_add": ("net localgroup administrators", "Add-LocalGroupMember -Group Administrators"),
        "domain_admin_add": ("Add-ADGroupMember", 'net group "Domain Admins"'),
        "create_account": ("net user /add", "New-LocalUser", "New-ADUser"),
        "uac_bypass": ("fodhelper", "eventvwr", "sdclt", "bypassuac"),
        "token_manipulation": ("ImpersonateLoggedOnUser", "SeDebugPrivilege"),
        "credential_dump": ("Invoke-Mimikatz", "sekurlsa", "MiniDumpWriteDump"),
    },
    "linux_suspicious": {
        "chmod": ("chmod +s", "chmod 4755", "chmod 777 /tmp"),
        "chown": ("chown root:", "chown 0:0"),
        "cron": ("crontab -", "* * * * * curl", "/etc/cron.d/"),
        "pipe_exec": (r"re:curl.*\|.*bash", r"re:wget.*\|.*sh"),
        "reverse_shell": ("bash -i >& /dev/tcp", "nc -e /bin/bash"),
        "passwd": ("/etc/passwd", "/etc/shadow", "useradd -o -u 0"),
        "disable": ("setenforce 0", "ufw disable", "iptables -F"),
        "staging": ("tar czf /tmp/", "base64 /etc/shadow"),
    },
    "linux_auditd": {
        "preload": ("LD_PRELOAD=", "/etc/ld.so.preload"),
        "kernel": ("dirtycow", "dirty_pipe", "CVE-2022-0847"),
        "cred": ("mimipenguin", "lazagne", "linpeas", "pspy"),
        "lateral": ("bloodhound", "crackmapexec", "kerbrute"),
        "tunnel": ("chisel", "ligolo", "frpc"),
    },
    "linux_auth": {
        "failure": ("Failed password",),
        "root_login": ("Accepted password for root", "Accepted publickey for root"),
        "sudo": ("sudo /bin/bash", "sudo -s", "sudo /usr/bin/vim", "COMMAND=/bin/bash", "COMMAND=/usr/bin/vim"),
        "authorized_keys": ("authorized_keys",),
    },
    "ai_model_integrity": {
        "model_file": (".gguf", ".bin", ".safetensors"),
        "known_port": (":11434", ":1234", ":8080", ":8000"),
    },
}

# name -> (score, regexes)
PS_DETECTORS: dict[str, tuple[float, tuple[str, ...]]] = {
    "obfuscation": (0.70, (r"`[a-zA-Z]", r"\$\{[^}]+\}", r"''\s*\+\s*''", r"-join\s*\(", r"\[char\]\s*\d+")),
    "download": (0.75, (r"Net\.WebClient", "Invoke-WebRequest", "DownloadString", "DownloadFile", "Start-BitsTransfer", "Invoke-RestMethod")),
    "amsi": (0.85, ("amsiInitFailed", "AmsiScanBuffer", r"\[Ref\]\.Assembly\.GetType.*amsi", r"amsi\.dll.*VirtualProtect")),
    "encoded": (0.65, (r"-[Ee]nc(odedCommand)?\s+[A-Za-z0-9+/=]{20,}",)),
    "nested": (0.60, ("powershell.*powershell", "cmd.*powershell")),
}

# in order: (rule, image, score, confidence, tactic, technique, regexes on the lower-cased command line; none: any use)
LOTL = (
    ("LOTL-001", "vssadmin.exe", 0.92, 0.90, "Impact", "T1490", (r"delete\s+shadows", r"resize\s+shadowstorage")),
    ("LOTL-001b", "vssadmin.exe", 0.45, 0.45, "Discovery", "T1082", (r"list\s+shadows",)),
    ("LOTL-002", "wmic.exe", 0.80, 0.80, "Lateral Movement", "T1047", ("/node:", r"process\s+call\s+create")),
    ("LOTL-003", "mshta.exe", 0.85, 0.85, "Execution", "T1218.005", ("https?://", "javascript:", "vbscript:", r"\.hta")),
    ("LOTL-004", "certutil.exe", 0.82, 0.82, "Defense Evasion", "T1140", ("-urlcache", "-decode", "-encode", "-f https://")),
    ("LOTL-005", "rundll32.exe", 0.78, 0.78, "Defense Evasion", "T1218.011", (r"users\\public\\", r"url\.dll,fileprotocolhandler", r"windows\\temp\\", "javascript:")),
    ("LOTL-006", "schtasks.exe", 0.75, 0.75, "Persistence", "T1053.005", ("/create", r"/sc\s+(onlogon|onstart)", r"/tr\s+.*powershell", r"/tr\s+.*mshta")),
    ("LOTL-007", "cron", 0.70, 0.70, "Persistence", "T1053.003", (r"bash\s+-[ic]", r"curl\s+.*\|", r"wget\s+.*\|", "python.*-c", r"nc\s+-")),
    ("LOTL-007b", "at.exe", 0.60, 0.60, "Persistence", "T1053.002", ()),
    ("LOTL-008", "regsvr32.exe", 0.88, 0.88, "Defense Evasion", "T1218.010", (r"/s\s+/n\s+/u\s+/i:http", "/i:https?://", r"scrobj\.dll")),
)

# event code -> (score, confidence, title, tactic, technique)
TASK_EVENTS = {
    "4698": (0.70, 0.65, "Scheduled Task Created", "Persistence", "T1053.005"),
    "4699": (0.65, 0.60, "Scheduled Task Deleted", "Defense Evasion", "T1053.005"),
    "4702": (0.55, 0.50, "Scheduled Task Modified", "Persistence", "T1053.005"),
}

# (parent, child that it should not start)
SPAWN_PAIRS = (
    ("winword.exe", "powershell.exe"),
    ("winword.exe", "cmd.exe"),
    ("winword.exe", "wscript.exe"),
    ("winword.exe", "mshta.exe"),
    ("excel.exe", "powershell.exe"),
    ("excel.exe", "cmd.exe"),
    ("excel.exe", "wscript.exe"),
    ("excel.exe", "mshta.exe"),
    ("outlook.exe", "powershell.exe"),
    ("outlook.exe", "cmd.exe"),
    ("chrome.exe", "powershell.exe"),
    ("firefox.exe", "powershell.exe"),
    ("iexplore.exe", "powershell.exe"),
    ("iexplore.exe", "cmd.exe"),
    ("mshta.exe", "powershell.exe"),
    ("mshta.exe", "cmd.exe"),
    ("wscript.exe", "powershell.exe"),
    ("cscript.exe", "powershell.exe"),
    ("rundll32.exe", "powershell.exe"),
    ("regsvr32.exe", "powershell.exe"),
    ("regsvr32.exe", "cmd.exe"),
    ("services.exe", "cmd.exe"),
    ("lsass.exe", "cmd.exe"),
    ("svchost.exe", "cmd.exe"),
    ("svchost.exe", "powershell.exe"),
    ("taskeng.exe", "powershell.exe"),
    ("msiexec.exe", "powershell.exe"),
    ("msiexec.exe", "cmd.exe"),
    ("wmiprvse.exe", "powershell.exe"),
    ("wmiprvse.exe", "cmd.exe"),
    ("wmiprvse.exe", "wscript.exe"),
    ("sqlservr.exe", "cmd.exe"),
    ("sqlservr.exe", "powershell.exe"),
)

# local AI servers: (process, port); two share port 8080
AI_SERVERS = (("ollama", 11434), ("lm studio", 1234), ("llama-server", 8080), ("localai", 8080), ("vllm", 8000))
MODEL_SUFFIXES = (".gguf", ".bin", ".safetensors")

# catalogue of covered techniques for the gap report
CATALOGUE = (
    ("Impact", "T1490"), ("Discovery", "T1082"), ("Lateral Movement", "T1047"), ("Execution", "T1218.005"), ("Defense Evasion", "T1140"), ("Defense Evasion", "T1218.011"),
    ("Persistence", "T1053.005"), ("Persistence", "T1053.003"), ("Persistence", "T1053.002"), ("Defense Evasion", "T1218.010"), ("Execution", "T1059"), ("Discovery", "T1087"), ("Credential Access", "T1110.001"),
)

SENSITIVE_PATHS = ("/etc/shadow", "/etc/sudoers", "authorized_keys")
SCRIPT_SHELLS = ("bash", "python", "python3", "perl")
EXEC_TOOLS = ("/dev/tcp/", "nc -e /bin/bash", "socat EXEC")

# binary rules: names that must occur, how many of them, and a byte pattern in hex (?? is any byte)
BLOB_RULES = {
    "exact_sample": (("connect", "socket", "dup2", "execvp", "fork"), 5, "7F454C46", "23000000"),
    "family": (("socket", "connect", "dup2", "execvp", "inet_pton"), 3, "7F45", "0200????????????"),
}
