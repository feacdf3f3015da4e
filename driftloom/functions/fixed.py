"""Names that results depend on, as they are, in natural order."""

from __future__ import annotations

# Keys that change on every answer, compared without case, - and _.
VOLATILE_KEYS = frozenset({
    "sessionid", "mcpsessionid", "connectionid", "clientid", "requestid", "xrequestid", "correlationid", "traceid", "spanid", "progresstoken",
    "nonce", "cachebuster",
    "timestamp", "servertime", "currenttime", "generatedat", "retrievedat", "fetchedat", "observedat", "expiresat", "expiresin", "issuedat",
    "uptime", "uptimeseconds", "requestcount",
})
# Keys whose children are names that an author chose; keys whose subtree is data.
SCHEMA_MAPS = frozenset({"properties", "patternProperties", "definitions", "$defs", "dependentSchemas", "dependentRequired"})
OPAQUE_KEYS = frozenset({"const", "default", "enum", "example", "examples"})
# Arrays of objects by the member they are sorted by, and arrays of strings that are sorted.
SORTED_BY = {"tools": "name", "resources": "uri", "resourceTemplates": "uriTemplate", "prompts": "name"}
SORTED_STRINGS = frozenset({"required"})

# Parts of a manifest and of a tool that have kinds of their own.
MANIFEST_PARTS = ("tools", "prompts", "resources", "serverInfo", "capabilities")
TOOL_PARTS = ("name", "description", "annotations", "execution", "inputSchema")

# Verbs of tools that are never called, with their inflections.
ACTING = (
    r"\b(?:delete|destroy|drop|purge|remove|erase|wipe|truncate|revoke|reset|"
    r"send|email|mail|sms|notify|publish|post|tweet|share|invite|"
    r"pay|charge|refund|transfer|withdraw|buy|sell|order|checkout|subscribe|"
    r"deploy|release|merge|push|revert|rollback|restart|shutdown|kill|terminate|"
    r"create|update|write|upload|insert|modify|patch|rename|move|copy|"
    r"execute|exec|run|shell|eval|spawn|install|uninstall)(?:e?s|e?d|ing)?\b"
)

# How a demand for credentials, a broken dependency and a missing secret are told.
AUTH_STATUSES = (401, 402, 403, 407)
AUTH_CODES = (-32001, -32002)
AUTH_HINTS = ("unauthor", "unauthent", "auth required", "authentication", "forbidden", "api key")
CREDENTIAL_HINTS = ("api key", "api_key", "token", "credential", "unauthor", "must be set", "is required", "environment variable")
DEPENDENCY_HINTS = ("modulenotfounderror", "importerror", "cannot find module", "err_module_not_found")
# Status of an observation for each way a launch fails.
LAUNCH_STATUS = {
    "install_failed": "unreachable", "launch_failed": "unreachable", "dependency_broken": "unreachable", "timeout": "timeout",
    "requires_credentials": "auth_required", "protocol_error": "protocol_error", "crashed": "protocol_error",
}
# Flags that name a capability or an authority, not a size.
HIGH_SIGNAL_FLAGS = (
    "credential_param_added", "network_param_added", "filesystem_param_added", "imperative_language_added", "destructive_hint_cleared", "endpoint_or_repo_moved",
)
# Capabilities by the class of divergence that they count as.
CAPABILITY_CLASSES = {
    "network": "undeclared_network", "filesystem_read": "undeclared_filesystem", "filesystem_write": "undeclared_filesystem",
    "subprocess": "undeclared_subprocess", "credential_access": "undeclared_credential_access",
}

# Flags in output order.
FLAGS = (
    "network_param_added", "filesystem_param_added", "credential_param_added", "imperative_language_added", "tool_count_grew",
    "destructive_hint_cleared", "readonly_hint_set", "description_grew_sharply", "endpoint_or_repo_moved",
)
# Words that tell what a parameter reaches, then phrases that address the model.
NETWORK = r"(?U)\b(url|uri|endpoint|host|hostname|webhook|callback|proxy|upload|download|fetch|remote|address|ip|dns|port|origin|destination)\b"
FILES = r"(?U)\b(path|filepath|filename|file|directory|dir|folder|cwd|workdir|root|glob)\b"
CREDENTIALS = r"(?U)\b(token|key|apikey|secret|password|passwd|credential|credentials|auth|authorization|bearer|session)\b"
ORDERS = [
    "ignore previous", "ignore prior", "ignore all previous", "disregard previous", "disregard the above", "you must", "you should always",
    "always call", "always use", "do not tell", "do not mention", "without telling", "without informing", "do not reveal", "never mention",
    "never reveal", "before using any other", "before any other tool", "instead of", "system prompt", "new instructions", "important instruction", "override",
]
# Phrases and words of the rules that label a change; narrower than ORDERS, as a hit decides.
INJECTION = [
    "ignore previous", "ignore all previous", "ignore prior", "disregard previous", "disregard the above", "disregard any previous",
    "do not tell the user", "do not inform the user", "without telling the user", "without informing the user", "do not reveal",
    "never reveal to the user", "do not mention this", "never mention this", "before using any other tool", "before any other tool",
    "always call this tool first", "ignore the system prompt", "ignore your instructions", "override your instructions",
]
AUTHORITY = [
    "this tool takes precedence", "takes priority over", "highest priority", "trusted tool", "authoritative source", "must be used instead of",
    "supersedes", "overrides other tools", "do not use other", "preferred over all",
]
EXFILTRATION = r"(?U)\b(webhook|callback|exfil|forward_to|send_to|post_to|report_to|notify_url|upload_url|destination_url|remote_url|sink)\b"
COMMAND = r"(?U)\b(cmd|command|shell|exec|execute|script|eval|bash|sh|powershell|subprocess|system)\b"
# Labels from the most severe on, and kinds of changed texts.
PRECEDENCE = ["instruction_injection", "exfiltration_addition", "authority_escalation", "scope_expansion"]
TEXT_KINDS = ["tool_description_changed", "param_description_changed", "server_description_changed", "prompt_changed"]
