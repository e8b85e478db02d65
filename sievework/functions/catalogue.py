"""Fixed tables of the data model: rule maps, text rules, technology markers, risk signals, perspectives and their cases."""

from __future__ import annotations

# Native rule id, rule_id, category, severity by engine.
RULE_MAPS = {
    "lint": [
        ("HardcodedCredentials", "R-LT-001", "security/hardcoded-secret", "critical"),
        ("PlaintextPassword", "R-LT-001", "security/hardcoded-secret", "critical"),
        ("VisibleForTests", "R-LT-001", "security/hardcoded-secret", "info"),
        ("OpenForTesting", "R-LT-001", "security/hardcoded-secret", "info"),
        ("TrustAllX509TrustManager", "R-LT-002", "security/tls-trust-all", "critical"),
        ("BadHostnameVerifier", "R-LT-002", "security/tls-trust-all", "critical"),
        ("SetJavaScriptEnabled", "R-LT-003", "security/webview", "major"),
        ("AddJavascriptInterface", "R-LT-003", "security/webview", "major"),
        ("InsecureBaseConfiguration", "R-LT-004", "security/cleartext", "major"),
        ("CleartextSupported", "R-LT-004", "security/cleartext", "major"),
        ("ExportedReceiver", "R-LT-005", "security/exported-unprotected", "critical"),
        ("ExportedActivity", "R-LT-005", "security/exported-unprotected", "critical"),
        ("ExportedService", "R-LT-005", "security/exported-unprotected", "critical"),
        ("WorldReadableFiles", "R-LT-006", "security/world-readable", "critical"),
        ("WorldWriteableFiles", "R-LT-006", "security/world-readable", "critical"),
        ("SQLiteString", "R-LT-007", "security/sql-injection", "critical"),
        ("HardcodedDebugMode", "R-LT-008", "security/debuggable-enabled", "critical"),
        ("AllowBackup", "R-LT-009", "security/backup-allowed", "major"),
        ("UnsafeIntentLaunch", "R-LT-010", "security/intent-redirection", "critical"),
        ("IntentFilterUniquePermission", "R-LT-011", "security/receiver-export-flag", "major"),
        ("ExportedProvider", "R-LT-012", "security/exported-provider", "critical"),
        ("Recycle", "R-LT-013", "stability/resource-leak-cursor", "major"),
        ("Registered", "R-LT-014", "stability/listener-leak", "major"),
        ("ObsoleteSdkInt", "R-LT-015", "stability/deprecated-asynctask", "info"),
        ("DiscouragedApi", "R-LT-015", "stability/deprecated-asynctask", "minor"),
        ("CommitTransaction", "R-LT-016", "stability/fragment-state-loss", "major"),
        ("StaticFieldLeak", "R-LT-017", "stability/static-context-leak", "critical"),
        ("CoarseFineLocation", "R-LT-022", "stability/location-permission-pair", "critical"),
        ("SoonBlockedPrivateApi", "R-LT-023", "stability/non-sdk-api-enforcement", "critical"),
        ("PrivateApi", "R-LT-023", "stability/non-sdk-api-enforcement", "major"),
        ("WrongThread", "R-LT-018", "perf/main-thread-io", "major"),
        ("ViewHolder", "R-LT-019", "perf/rv-findviewbyid", "major"),
        ("UseBindingAdapter", "R-LT-019", "perf/rv-findviewbyid", "info"),
        ("DrawAllocation", "R-LT-020", "perf/hotpath-allocation", "major"),
        ("InefficientWeight", "R-LT-020", "perf/hotpath-allocation", "minor"),
        ("NestedWeights", "R-LT-020", "perf/hotpath-allocation", "minor"),
        ("DisableBaselineAlignment", "R-LT-020", "perf/hotpath-allocation", "info"),
        ("UnusedResources", "R-LT-021", "perf/unbounded-cache", "info"),
    ],
    "detekt": [
        ("TooGenericExceptionCaught", "R-DK-001", "stability/swallowed-exception", "major"),
        ("SwallowedException", "R-DK-001", "stability/swallowed-exception", "major"),
        ("EmptyCatchBlock", "R-DK-001", "stability/swallowed-exception", "major"),
        ("GlobalCoroutineUsage", "R-DK-002", "stability/globalscope", "major"),
        ("InjectDispatcher", "R-DK-002", "stability/globalscope", "minor"),
        ("SleepInsteadOfDelay", "R-DK-002", "stability/blocking-call-in-coroutine", "major"),
        ("SuspendFunWithFlowReturnType", "R-DK-002", "stability/coroutine-api-misuse", "minor"),
        ("UnnecessaryNotNullOperator", "R-DK-003", "stability/kotlin-not-null-assert", "minor"),
        ("UnsafeCallOnNullableType", "R-DK-003", "stability/kotlin-not-null-assert", "major"),
        ("NullableToStringCall", "R-DK-003", "stability/kotlin-not-null-assert", "minor"),
        ("UnsafeCast", "R-DK-003", "stability/kotlin-not-null-assert", "major"),
        ("LateinitUsage", "R-DK-003", "stability/kotlin-not-null-assert", "minor"),
        ("UselessCallOnNotNull", "R-DK-003", "stability/kotlin-not-null-assert", "info"),
        ("ForbiddenComment", "R-DK-004", "security/hardcoded-secret", "info"),
        ("HasPlatformType", "R-DK-005", "stability/platform-type", "minor"),
        ("UnreachableCode", "R-DK-006", "stability/unreachable-code", "minor"),
        ("InvalidRange", "R-DK-007", "stability/invalid-range", "major"),
        ("IteratorHasNextCallsNextMethod", "R-DK-008", "stability/iterator-contract", "major"),
        ("IteratorNotThrowingNoSuchElementException", "R-DK-008", "stability/iterator-contract", "major"),
        ("MapGetWithNotNullAssertionOperator", "R-DK-003", "stability/kotlin-not-null-assert", "major"),
        ("UnconditionalJumpStatementInLoop", "R-DK-009", "stability/loop-control", "minor"),
        ("WrongEqualsTypeParameter", "R-DK-010", "stability/equals-contract", "major"),
    ],
    "pmd": [
        ("CloseResource", "R-STB-001", "stability/resource-leak", "major"),
        ("DoNotUseThreads", "R-STB-013", "stability/raw-thread", "minor"),
        ("AvoidThreadGroup", "R-STB-013", "stability/raw-thread", "minor"),
        ("UnsynchronizedStaticFormatter", "R-STB-030", "stability/non-threadsafe-formatter", "major"),
        ("AvoidUsingHardCodedIP", "R-SEC-001", "security/hardcoded-secret", "minor"),
        ("HardCodedCryptoKey", "R-SEC-001", "security/hardcoded-secret", "critical"),
        ("AvoidFileStream", "R-PRF-001", "perf/unbuffered-file-stream", "minor"),
    ],
}
HIGH_SIGNAL = ("CloseResource", "UnsynchronizedStaticFormatter", "HardCodedCryptoKey")
HIGH_SIGNAL_SETS = ("errorprone", "multithreading", "security")

_CODE = ["*.java", "*.kt"]
_MANIFEST = ["AndroidManifest.xml"]
_STUBS = ["*/aidl/*.java", "*/aidl/*.kt", "*Stub*.java", "*Aidl*.java"]
# rule_id, pattern, category, severity, paths of the rules that are regular expressions over whole texts.
TEXT_RULES = [
    ("R-SG-001", r'(?i)\b(api[_\-]?key|secret|password|access[_\-]?key|private[_\-]?key|auth[_\-]?token|bearer)\s*[:=]\s*"[^"]{8,}"', "security/hardcoded-secret", "critical", _CODE),
    ("R-SG-001", r"(?i)(api[_\-]?key|secret|password|access[_\-]?key|private[_\-]?key|auth[_\-]?token|bearer)\s*[=:]\s*[^\s]{8,}", "security/hardcoded-secret", "critical", ["*.properties", "*.gradle", "*.gradle.kts"]),
    ("R-SG-003", r"HostnameVerifier[^{]*\{[^}]*return\s+true", "security/tls-trust-all", "critical", _CODE),
    ("R-SG-004", r"onReceivedSslError[\s\S]{0,400}?\.proceed\s*\(", "security/webview", "critical", _CODE),
    ("R-SG-005", r'android:usesCleartextTraffic\s*=\s*"true"', "security/cleartext", "major", ["AndroidManifest.xml", "network_security_config.xml"]),
    ("R-SG-005", r'"http://[^"]{4,}"', "security/cleartext", "major", _CODE),
    ("R-SG-007", r'android:exported\s*=\s*"true"', "security/exported-unprotected", "critical", _MANIFEST),
    ("R-SG-008", r"MODE_WORLD_(READABLE|WRITEABLE)", "security/world-readable", "critical", _CODE),
    ("R-SG-010", r"\bLog\.(v|d|i|w|e|wtf)\s*\([^)]*\b(vin|imei|token|password|phone|latitude|longitude|location|uid|deviceId|mac)\b", "security/log-leakage", "major", _CODE),
    ("R-SG-014", r'android:debuggable\s*=\s*"true"', "security/debuggable-enabled", "critical", _MANIFEST),
    ("R-SG-014", r"(?m)^\s*debuggable\s+true\b", "security/debuggable-enabled", "critical", ["*.gradle", "*.gradle.kts"]),
    ("R-SG-015", r'android:allowBackup\s*=\s*"true"', "security/backup-allowed", "major", _MANIFEST),
    ("R-SG-018", r'<provider\b[^>]*android:exported\s*=\s*"true"', "security/exported-provider", "critical", _MANIFEST),
    ("R-SG-023", r"\b(registerReceiver|registerContentObserver|registerListener|addCallback|addListener)\s*\(", "stability/listener-leak", "major", _CODE),
    ("R-SG-029", r"\.subscribe\s*\(", "stability/rxjava-disposable-leak", "major", _CODE),
    ("R-SG-032", r"!!(?![=])", "stability/kotlin-not-null-assert", "minor", ["*.kt"]),
    ("R-SG-038", r"UncaughtExceptionHandler|setDefaultUncaughtExceptionHandler", "stability/crash-handler-recursion", "critical", _CODE),
    ("R-SG-039", r"interface\s+[A-Za-z_]\w*", "stability/aidl-backward-compat", "critical", _STUBS),
    ("R-SG-040", r"throws\s+[A-Z]\w+Exception", "stability/aidl-checked-exception", "major", _STUBS),
    ("R-SG-047", r"new\s+URL\s*\([^)]+\)\.openConnection", "perf/main-thread-network", "critical", _CODE),
    ("R-SG-053", r'"(?i)SELECT\s+\*', "perf/inefficient-sql", "minor", _CODE),
    ("R-SG-060", r"android\.permission\.ACCESS_FINE_LOCATION", "stability/location-permission-pair", "critical", _MANIFEST),
]

# A file uses a technology if its marker stands anywhere in it.
MARKERS = {
    "webview": r"WebView|WebViewClient|WebChromeClient|addJavascriptInterface|loadDataWithBaseURL|\bloadUrl\b|evaluateJavascript|CookieManager|com\.tencent\.smtt|webview_flutter|react-native-webview|<WebView",
    "ipc_aidl": r"\.Stub\b|extends\s+\w+\.Stub|\bIInterface\b|\bonTransact\b|\bMessenger\b|\.aidl\b|JNIEXPORT|RegisterNatives",
    "platform_surface": r"PendingIntent\.(?:getActivity|getBroadcast|getService|getForegroundService)|\bregisterReceiver\s*\(|RECEIVER_(?:EXPORTED|NOT_EXPORTED)|BroadcastReceiver|Notification(?:Manager|Compat)|RemoteViews|AppWidget|\bstartActivity\s*\(|ActivityOptions|MODE_BACKGROUND_ACTIVITY_START|taskAffinity|launchMode",
    "content_provider": r"ContentProvider|ContentResolver|content://|UriMatcher",
    "long_conn": r"\bSocket\b|WebSocket|OkHttpClient|\bMqtt|\bXMPP\b|EventSource",
    "database": r"SQLiteOpenHelper|rawQuery|execSQL|@Dao\b|RoomDatabase|ContentValues|SQLiteDatabase",
    "native": r"System\.loadLibrary|System\.load\b|DexClassLoader|InMemoryDexClassLoader|\bJNI(?:EXPORT|Env)?\b|RegisterNatives|#\s*include\s*[<\"]jni\.h[>\"]|\b(?:external|native)\s+fun\b|\bstd::",
    "crypto": r"\bCipher\b|MessageDigest|KeyStore|SecretKey|\bIvParameterSpec\b",
    "concurrency": r"\bsynchronized\b|\bvolatile\b|Atomic[A-Z]\w+|ExecutorService|\bThread\b|CoroutineScope|runBlocking|GlobalScope",
    "reflection": r"Class\.forName|getDeclaredMethod|getMethod\s*\(|\.invoke\s*\(|getDeclaredField",
    "exported": r'android:exported\s*=\s*"true"',
    "storage_privacy": r"SharedPreferences|DataStore|ClipboardManager|MediaStore|FileProvider|FLAG_SECURE",
    "network": r"Retrofit|OkHttpClient|HttpURLConnection|networkSecurityConfig|CertificatePinner|NsdManager|MulticastSocket|DatagramSocket|WifiAwareManager",
    "work_background": r"WorkManager|Worker\b|JobScheduler|ForegroundService|startForeground|AlarmManager",
    "room": r"@Database\b|@Dao\b|RoomDatabase|@Transaction\b|Migration\b",
    "compose": r"@Composable\b|rememberSaveable|LaunchedEffect|collectAsStateWithLifecycle",
    "deeplink": r"autoVerify|intent-filter|ACTION_VIEW|getDataString|getQueryParameter",
    "permissions": r"<uses-permission|requestPermissions|checkSelfPermission|AppOpsManager|ACCESS_(?:FINE|COARSE|BACKGROUND)_LOCATION|NEARBY_WIFI_DEVICES|POST_NOTIFICATIONS|ACCESS_LOCAL_NETWORK|NsdManager|MulticastSocket|WifiAwareManager|BluetoothManager|WifiManager|MediaProjectionManager|HealthConnectClient|android\.permission\.health|READ_MEDIA_(?:IMAGES|VIDEO|AUDIO)|READ_HEALTH_DATA_IN_BACKGROUND",
    "hidden_api": r"getDeclaredField|getDeclaredMethod|setAccessible\s*\(\s*true|dalvik\.system|VMRuntime",
    "sdk_library": r"com\.android\.library|consumerProguardFiles|externalNativeBuild|System\.loadLibrary|api\s+project|implementation\s+project",
    "privacy_identity": r"ANDROID_ID|Build\.getSerial|TelephonyManager|getImei|getDeviceId|AdvertisingId|SSID|BSSID|LocationManager|ACCESS_FINE_LOCATION",
    "failure_contract": r"ThreadPoolExecutor|RejectedExecution|execute\s*\(|enqueue\s*\(|retry|backoff|shutdown",
    "state_snapshot": r"System\.currentTimeMillis|elapsedRealtime|synchronized|volatile|Atomic|snapshot|generation",
    "serialization": r"ObjectInputStream|readObject\s*\(|getSerializableExtra|Parcelable|Parcelize|Gson|Moshi|kotlinx\.serialization|Json\.decodeFromString",
    "logic_state_machine": r"enum\s+class\s+\w*(?:State|Status)|sealed\s+(?:class|interface)\s+\w*(?:State|Status)|\b(?:state|status|phase|generation)\b|onSuccess|onFailure|compareAndSet",
    "logic_identity": r"\b(?:accountId|userId|tenantId|profileId|sessionId|currentUser|switchAccount)\b",
    "logic_numeric": r"\b(?:BigDecimal|amount|price|balance|quota|limit|remaining|currency|roundingMode)\b",
    "logic_pagination": r"\b(?:pageToken|nextToken|nextCursor|cursor|offset|hasMore|loadMore|dedup)\b",
    "logic_temporal": r"\b(?:Instant|LocalDate|ZonedDateTime|Calendar|TimeZone|expiresAt|ttl|deadline)\b|currentTimeMillis|elapsedRealtime",
}

# Signals of risk and their weights.
SIGNALS = [
    (r"addJavascriptInterface", 4),
    (r"setAllowUniversalAccessFromFileURLs\s*\(\s*true", 4),
    (r"setAllowFileAccessFromFileURLs\s*\(\s*true", 3),
    (r'android:exported\s*=\s*"true"', 3),
    (r"Runtime\.getRuntime\(\)\.exec|new\s+ProcessBuilder", 4),
    (r"DexClassLoader|InMemoryDexClassLoader|System\.load\b", 4),
    (r"\.Stub\b|extends\s+\w+\.Stub", 2),
    (r"Class\.forName|\.invoke\s*\(", 2),
    (r"Intent\.parseUri|getParcelableExtra|getSerializableExtra", 2),
    (r"rawQuery\s*\([^)]*\+|execSQL\s*\([^)]*\+", 3),
    (r"MODE_WORLD_(READABLE|WRITEABLE)", 3),
    (r"checkServerTrusted|HostnameVerifier|onReceivedSslError", 3),
    (r"\bloadUrl\b|loadDataWithBaseURL|evaluateJavascript", 2),
    (r"\bWebView\b", 1),
]

# Perspectives and the tags that call for them (none: always).
GATES = {
    "auth_dataflow": (),
    "business_logic": (),
    "platform_ipc": ("ipc_aidl", "content_provider", "exported", "deeplink", "platform_surface"),
    "permissions_platform": ("permissions", "hidden_api"),
    "lifecycle_concurrency": (),
    "state_consistency": ("state_snapshot", "concurrency"),
    "failure_reliability": (),
    "storage_privacy": ("storage_privacy", "content_provider", "serialization"),
    "privacy_consent": ("privacy_identity", "permissions"),
    "network_crypto": ("network", "crypto", "long_conn"),
    "performance": (),
    "modern_runtime": ("compose", "room", "work_background"),
    "webview": ("webview",),
    "native_dependency": ("native",),
    "sdk_integration": ("sdk_library", "native"),
    "free": (),
}
# Numbers of the cases (R-AI-NNN) of each perspective.
CASES = {
    "auth_dataflow": (1, 2, 3, 4, 12, 13, 68, 69),
    "business_logic": (67, 68, 69, 70, 71, 72),
    "platform_ipc": (26, 27, 28, 29, 30, 44, 47, 49, 60, 63, 66),
    "permissions_platform": (46, 51, 52, 61, 62, 65),
    "lifecycle_concurrency": (5, 6, 7, 8, 14, 15, 16, 17, 39, 40),
    "state_consistency": (54, 56, 57, 67, 70, 71, 72),
    "failure_reliability": (41, 43, 55, 61, 67, 70),
    "storage_privacy": (31, 32, 35, 36),
    "privacy_consent": (46, 59),
    "network_crypto": (3, 33, 34, 50, 58, 62),
    "performance": (9, 10, 11),
    "modern_runtime": (41, 42, 43, 45),
    "webview": (18, 19, 20, 21, 22, 23, 24, 25, 48),
    "native_dependency": (37, 38, 58, 64),
    "sdk_integration": (38, 53, 54, 61, 64),
    "free": (),
}

# Defaults and least values of the batching policy, and the engines that a policy may exclude.
POLICY = {"samples": ("hunt_samples", 2, 1), "batch_size": ("hunt_batch_size", 10, 1), "token_budget": ("hunt_token_budget", 24_000, 1_000)}
ENGINES = ("semgrep", "detekt", "pmd", "lint", "ai")


def rule_map(spark, engine: str):
    return spark.createDataFrame(RULE_MAPS[engine], "native_rule_id string, rule_id string, category string, severity string")


def text_rules() -> list[dict]:
    return [dict(zip(("rule_id", "pattern", "category", "severity", "paths"), r)) for r in TEXT_RULES]


def gate_rows() -> list[tuple]:
    return [(p, tag) for p, tags in GATES.items() for tag in (tags or (None,))]


def case_rows() -> list[tuple]:
    return [(p, f"R-AI-{n:03d}") for p, numbers in CASES.items() for n in numbers]


def policy(settings) -> dict[str, int]:
    """Whole numbers of the settings that reach their least value, else the defaults; true is no number."""
    settings = settings if isinstance(settings, dict) else {}
    return {k: v if type(v := settings.get(name, default)) is int and v >= least else default for k, (name, default, least) in POLICY.items()}


def excluded_engines(settings) -> list[str]:
    raw = settings.get("excluded_engines") if isinstance(settings, dict) else None
    names = [x.strip().lower() for x in raw if isinstance(x, str)] if isinstance(raw, list) else []
    return list(dict.fromkeys(n for n in names if n in ENGINES))


# Fields of a run manifest that later phases may not change.
MANIFEST_FIELDS = [
    "schema_version", "run_id", "started_at", "source_only",
    "repo_revision", "repo_dirty", "skill_fingerprint", "config_fingerprint",
    "language", "scan_mode", "scope", "config_trusted",
    "effective_hunt_policy", "effective_excluded_engines",
]
# What an auditor may say of a case.
DISPOSITIONS = ["agree_no_signal", "agree_mitigated", "new_candidate", "unresolved"]

# Whole paths whose change reaches every file, and file names whose change reaches their module.
GLOBAL_FILES = ["settings.gradle", "settings.gradle.kts", "build.gradle", "build.gradle.kts", "gradle.properties", "gradle/libs.versions.toml", "gradle/verification-metadata.xml"]
MODULE_WIDE = ["AndroidManifest.xml", "build.gradle", "build.gradle.kts", "proguard-rules.pro", "consumer-rules.pro", "network_security_config.xml", "data_extraction_rules.xml", "backup_rules.xml"]

# Rules over the structure of code: id, category, severity, extensions, patterns (one of them has to match; $X is any
# expression, ... any arguments), and conditions: a block header that has to be, or a pattern that must not be, around the match.
_J, _K, _JK = (".java",), (".kt",), (".java", ".kt")
STRUCTURAL = [
    ("R-SG-002", "security/weak-crypto", "critical", _JK, ['$X.getInstance("...")'], {"literal": r"^(DES|RC4|MD5|SHA-?1|AES/ECB/.*)"}),
    ("R-SG-004", "security/webview", "major", _JK, ["$WEBVIEW.getSettings().setJavaScriptEnabled(true)"], {}),
    ("R-SG-004", "security/webview", "major", _JK, ["$WS.setAllowFileAccess(true)", "$WS.setAllowFileAccessFromFileURLs(true)", "$WS.setAllowUniversalAccessFromFileURLs(true)"], {}),
    ("R-SG-004", "security/webview", "major", _JK, ["$WV.addJavascriptInterface(...)"], {}),
    ("R-SG-004", "security/webview", "major", _JK, ["$WV.setWebContentsDebuggingEnabled(true)"], {}),
    ("R-SG-004", "security/webview", "major", _JK, ["$WV.loadDataWithBaseURL(...)"], {}),
    ("R-SG-006", "security/pendingintent-mutability", "major", _JK, ["PendingIntent.getActivity(...)", "PendingIntent.getBroadcast(...)", "PendingIntent.getService(...)", "PendingIntent.getActivities(...)"], {}),
    ("R-SG-009", "security/weak-random", "major", _J, ["new Random()"], {}),
    ("R-SG-009", "security/weak-random", "major", _JK, ["Math.random()"], {}),
    ("R-SG-011", "security/sql-injection", "critical", _J, ["$DB.rawQuery($SQL + $X, $ARGS)", "$DB.execSQL($SQL + $X)"], {}),
    ("R-SG-012", "security/command-injection", "critical", _JK, ["Runtime.getRuntime().exec(...)", "new ProcessBuilder(...)"], {}),
    ("R-SG-016", "security/intent-redirection", "critical", _JK, ["$I.getParcelableExtra(...)", "$I.getSerializableExtra(...)"], {}),
    ("R-SG-017", "security/receiver-export-flag", "major", _JK, ["$CTX.registerReceiver($R, $F)", "$CTX.registerReceiver($R, $F, $PERM, $H)"], {"unless": ["$CTX.registerReceiver(null, $F)", "$CTX.registerReceiver(null, $F, $PERM, $H)"]}),
    ("R-SG-019", "security/unsafe-deserialization", "major", _JK, ["new ObjectInputStream(...)"], {}),
    ("R-SG-019", "security/unsafe-deserialization", "critical", _JK, ["new DexClassLoader(...)", "new InMemoryDexClassLoader(...)", "System.load(...)"], {}),
    ("R-SG-021", "stability/resource-leak-cursor", "major", _J, [], {"held": "rawQuery|query"}),
    ("R-SG-022", "stability/resource-leak-stream", "major", _J, [], {"made": "FileInputStream|FileOutputStream|BufferedReader|BufferedWriter|FileReader|FileWriter|InputStreamReader"}),
    ("R-SG-025", "stability/inner-class-leak", "major", _J, ["new Handler() {", "new Handler($L) {", "new Runnable() {"], {}),
    ("R-SG-027", "stability/unnamed-thread", "minor", _JK, ["new Thread($R).start()", "Executors.newFixedThreadPool($N)", "Executors.newCachedThreadPool()", "Executors.newSingleThreadExecutor()"], {}),
    ("R-SG-030", "stability/sp-commit-sync", "minor", _JK, ["$EDITOR.commit()"], {}),
    ("R-SG-031", "stability/fragment-state-loss", "major", _JK, ["$FM.commitAllowingStateLoss()"], {}),
    ("R-SG-033", "stability/globalscope", "major", _K, ["GlobalScope.launch {", "GlobalScope.async {"], {}),
    ("R-SG-034", "stability/wrong-lock-object", "critical", _J, ["synchronized(Boolean.TRUE)", "synchronized(Boolean.FALSE)", "synchronized(Integer.valueOf($N))", 'synchronized("...")', "synchronized(true)", "synchronized(false)"], {}),
    ("R-SG-035", "stability/wakelock-leak", "major", _JK, ["$WAKELOCK.acquire(...)"], {}),
    ("R-SG-036", "stability/async-ui-update", "major", _JK, ["$A.runOnUiThread(...)", "Handler(Looper.getMainLooper()).post(...)"], {}),
    ("R-SG-037", "stability/room-migration", "critical", _JK, ["$BUILDER.fallbackToDestructiveMigration(...)"], {}),
    ("R-SG-041", "stability/fgs-start-timeout", "critical", _JK, ["$CTX.startForegroundService(...)"], {}),
    ("R-SG-042", "stability/fgs-type-missing", "critical", _JK, ["$S.startForeground($ID, $NOTIF)"], {}),
    ("R-SG-044", "stability/livedata-wrong-owner", "major", _JK, ["$LIVEDATA.observe(this, $OBSERVER)"], {}),
    ("R-SG-045", "perf/main-thread-io", "major", _JK, ["new FileInputStream(...)", "new FileOutputStream(...)", "new FileReader(...)", "new FileWriter(...)", "Files.readAllBytes(...)", "Files.write(...)", "Files.newInputStream(...)", "Files.newOutputStream(...)"], {}),
    ("R-SG-046", "perf/main-thread-db", "major", _JK, ["$BUILDER.allowMainThreadQueries()"], {}),
    ("R-SG-046", "perf/main-thread-db", "major", _JK, ["$HELPER.getWritableDatabase()", "$HELPER.getReadableDatabase()"], {}),
    ("R-SG-047", "perf/main-thread-network", "critical", _JK, ["$CALL.execute()"], {}),
    ("R-SG-048", "perf/hotpath-allocation", "major", _J, ["new $OBJ(...)"], {"inside": "protected void onDraw(Canvas $C)"}),
    ("R-SG-048", "perf/hotpath-allocation", "major", _K, ["$T(...)"], {"inside": "override fun onDraw($C: Canvas)"}),
    ("R-SG-049", "perf/rv-findviewbyid", "major", _J, ["$V.findViewById(...)"], {"inside": "public void onBindViewHolder($VH $HOLDER, int $POS)"}),
    ("R-SG-049", "perf/rv-findviewbyid", "major", _K, ["$V.findViewById(...)"], {"inside": "override fun onBindViewHolder($HOLDER: $VH, $POS: Int)"}),
    ("R-SG-050", "perf/regex-recompile", "minor", _J, ['Pattern.compile("...")'], {"unless": ['static $TYPE $VAR = Pattern.compile("...")', 'static final $TYPE $VAR = Pattern.compile("...")']}),
    ("R-SG-051", "perf/bitmap-oom-risk", "major", _JK, ["BitmapFactory.decodeFile($PATH)", "BitmapFactory.decodeResource($RES, $ID)", "BitmapFactory.decodeStream($IS)", "BitmapFactory.decodeByteArray($BYTES, $OFF, $LEN)"], {}),
    ("R-SG-052", "perf/inflate-in-loop", "major", _J, ["$INFLATER.inflate(...)"], {"inside": "for (...)"}),
    ("R-SG-054", "perf/db-write-no-transaction", "major", _J, ["$DB.insert(...)", "$DB.insertOrThrow(...)", "$DB.insertWithOnConflict(...)", "$DB.execSQL(...)", "$DB.update(...)", "$DB.delete(...)", "$DB.replace(...)"], {"inside": "for (...)"}),
    ("R-SG-055", "perf/heavy-onreceive", "major", _J, ["new FileInputStream(...)", "new FileOutputStream(...)", "$DB.getWritableDatabase()", "$DB.getReadableDatabase()", "$DB.rawQuery(...)", "$DB.query(...)", "Thread.sleep(...)"], {"inside": "public void onReceive(Context $CTX, Intent $INTENT)"}),
    ("R-SG-055", "perf/heavy-onreceive", "major", _K, ["FileInputStream(...)", "FileOutputStream(...)", "$DB.getWritableDatabase()", "$DB.getReadableDatabase()", "$DB.rawQuery(...)", "Thread.sleep(...)"], {"inside": "override fun onReceive($CTX: Context, $INTENT: Intent)"}),
    ("R-SG-061", "stability/non-sdk-api-enforcement", "critical", _JK, ['InetAddress.class.getDeclaredField("impl")', '$M.invoke(InetAddress.class, "impl")'], {}),
]

# Taint rules over both languages, test code left out: id, category, severity, sources, sinks.
_OUTSIDE = ["$I.getStringExtra(...)", "$I.getDataString()", "$U.getQueryParameter(...)", "$B.getString(...)"]
TAINT_SKIP = ["**/test/**", "**/androidTest/**"]
TAINT = [
    ("R-SG-056", "security/webview-untrusted-data-flow", "critical", [*_OUTSIDE, "$I.getCharSequenceExtra(...)", "$I.getData()"], ["$WV.loadUrl(...)", "$WV.evaluateJavascript(...)", "$WV.loadData(...)", "$WV.loadDataWithBaseURL(...)"]),
    ("R-SG-057", "security/command-injection-data-flow", "critical", _OUTSIDE, ["$R.exec(...)", "ProcessBuilder(...)"]),
    ("R-SG-058", "security/sql-injection-data-flow", "critical", _OUTSIDE, ["$DB.rawQuery(...)", "$DB.execSQL(...)", "$DB.compileStatement(...)"]),
    ("R-SG-059", "security/path-traversal-data-flow", "critical", [*_OUTSIDE, "$ENTRY.getName()"], ["File($PATH)", "File($BASE, $PATH)", "FileInputStream($PATH)", "FileOutputStream($PATH)", "$CTX.openFileOutput($PATH, ...)"]),
]
