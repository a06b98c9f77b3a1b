"""Rule tables as plain data. They must equal the published rules for equal results."""

# ---- fixed values: keyword lists per sector -------------------------------------------------
CATEGORY_KEYWORDS = {
    "water": [
        "water district", "water authority", "water department", "wastewater", "sewage", "water treatment",
        "water reclamation", "freshwater treatment", "potable water", "treatment plant", "water utility",
        "water quality", "water management", "public water", "water compliance", "water systems",
    ],
    "agriculture": [
        "agriculture", "farm", "irrigation", "crop", "agricultural", "farming", "irrigation district",
        "water conservation", "precision agriculture", "agricultural water", "farm operations",
        "irrigation systems", "water resources",
    ],
    "healthcare": [
        "hospital", "medical center", "healthcare facility", "medical facility", "patient care", "legionella",
        "water safety", "healthcare", "patient safety", "medical", "health system", "healthcare system",
        "healthcare services",
    ],
    "emergency": [
        "emergency management", "critical infrastructure", "emergency operations", "public safety",
        "emergency response", "disaster management", "alerting system", "notification system",
        "emergency services", "emergency preparedness", "crisis management",
    ],
}

PROCESS_KEYWORDS = {
    "water": [
        "treatment plant", "distribution system", "water quality monitoring", "pumping station",
        "flow measurement", "chlorination", "filtration", "turbidity monitoring", "pH control",
        "chemical dosing", "level sensors", "pressure monitoring", "compliance reporting",
    ],
    "wastewater": [
        "treatment facility", "effluent monitoring", "lift station", "aeration control", "sludge processing",
        "influent screening", "discharge monitoring", "odor control", "solids handling", "process control",
    ],
    "agriculture": [
        "irrigation system", "center pivot", "drip irrigation", "soil moisture monitoring",
        "water conservation", "precision irrigation", "fertigation", "pump control", "water allocation",
        "multiple water sources", "canal management",
    ],
    "oil_gas": [
        "wellhead monitoring", "pipeline monitoring", "pump station", "compressor station", "fluid level",
        "pressure regulation", "flow metering", "cathodic protection", "leak detection",
    ],
    "utility": [
        "substation", "distribution network", "power quality", "outage management", "load balancing",
        "circuit breaker", "transformer monitoring", "fault detection", "demand response", "grid management",
    ],
    "municipal": [
        "public works", "utility management", "infrastructure monitoring", "municipal service",
        "city operations", "resource management",
    ],
    "transportation": [
        "traffic management", "signal control", "tunnel system", "ventilation control", "tollbooth",
        "bridge monitoring", "road condition monitoring",
    ],
    "engineering": ["facility modernization", "infrastructure projects"],
    "healthcare": [
        "environmental monitoring", "critical systems", "air handling", "temperature control",
        "humidity monitoring", "medical gas systems", "equipment monitoring",
    ],
}

CHALLENGE_KEYWORDS = [
    "distributed operations", "24/7 operations", "unmanned facilities", "process optimization",
    "operational efficiency", "compliance reporting", "data logging requirements", "alarm management",
    "emergency response", "continuous monitoring", "reduce operator workload", "minimize site visits",
    "real-time visibility", "audit trail", "historical data", "trend analysis", "predictive maintenance",
    "critical infrastructure", "resource optimization",
]

REGULATORY_KEYWORDS = [
    "regulatory compliance", "EPA requirements", "water quality standards", "environmental monitoring",
    "discharge permits", "emissions monitoring", "safety regulations", "documentation requirements",
    "audit requirements", "continuous monitoring requirements", "reporting obligations",
    "public health standards", "NPDES permit", "Clean Water Act", "Safe Drinking Water Act",
    "air quality standards",
]

SECTOR_INFRASTRUCTURE = {
    "water": ["treatment plant", "distribution system", "pumping station", "well field", "reservoir",
              "storage tank", "booster station"],
    "wastewater": ["treatment plant", "collection system", "lift station", "pump station", "clarifier",
                   "digester", "aeration basin", "lagoon"],
    "agriculture": ["irrigation system", "pumping station", "canal network", "reservoir",
                    "distribution network", "center pivot", "drip system"],
    "oil_gas": ["wellhead", "pipeline", "pump station", "compressor station", "storage facility",
                "processing plant", "terminal"],
    "utility": ["substation", "distribution network", "transmission line", "generating facility",
                "switching station", "meter station"],
    "municipal": ["water system", "sewer system", "stormwater system", "public works",
                  "multiple facilities", "city infrastructure"],
    "transportation": ["traffic signal network", "tunnel system", "bridge system", "toll system",
                       "transit system", "airport infrastructure"],
    "engineering": ["project portfolio", "client facilities", "infrastructure projects",
                    "industrial facilities", "municipal clients"],
    "healthcare": ["hospital building", "medical campus", "central plant", "multiple facilities",
                   "critical care areas"],
}

SECTOR_PROCESSES = {
    "water": ["disinfection", "filtration", "chemical treatment", "monitoring", "sampling", "testing",
              "quality control", "pressure management"],
    "wastewater": ["biological treatment", "solids handling", "aeration", "disinfection", "sampling",
                   "testing", "discharge monitoring", "sludge processing"],
    "agriculture": [],
    "oil_gas": ["extraction", "transportation", "processing", "monitoring", "pressure regulation",
                "flow measurement", "leak detection"],
    "utility": ["power distribution", "load management", "outage response", "voltage regulation",
                "power quality", "demand response"],
    "municipal": ["utility management", "public works operations", "service delivery",
                  "resource management", "infrastructure maintenance"],
    "transportation": ["traffic management", "system monitoring", "safety systems",
                       "ventilation control", "lighting control", "access control"],
    "engineering": ["design services", "consulting", "system specification", "project management",
                    "construction management"],
    "healthcare": ["environmental monitoring", "temperature control", "air handling",
                   "medical gas systems", "equipment monitoring"],
}

COMPETITOR_INDICATORS = [
    "SCADA integration services", "control system integration", "system integrator",
    "automation contractor", "SCADA software provider", "automation solutions provider",
    "controls contractor", "industrial automation company", "SCADA programming",
    "PLC programming services", "HMI development", "control panel manufacturer",
    "automation engineering firm", "SCADA system design", "integration specialist",
    "automation consultant", "control systems engineering", "SCADA expertise", "we provide SCADA",
    "SCADA solutions", "SCADA capabilities",
]
COMPETITOR_PHRASES = ["scada integrator", "scada provider", "system integrator", "integration services"]

EXCLUDED_COMPETITORS = [
    "scada integrator", "automation company", "control systems integrator", "industrial automation",
    "systems integrator", "automation integrator", "controls contractor", "automation contractor",
    "plc programming",
]
EXCLUDED_SECTORS = [
    "retail", "consumer goods", "technology", "software", "financial", "banking", "insurance",
    "education", "restaurant", "hospitality", "entertainment", "media", "marketing", "advertising",
]
EXCLUSION_SERVICES = [
    "automation systems", "controls systems", "industrial controls", "control system integration",
    "scada integration", "control systems", "plc integration", "hmi development", "automation solutions",
]

TYPE_BASE_RELEVANCE = {
    "water": 0.8, "agriculture": 0.7, "healthcare": 0.8, "emergency": 0.7, "engineering": 0.6,
    "government": 0.5, "municipal": 0.6, "utility": 0.7, "transportation": 0.5, "oil_gas": 0.6,
}
TYPE_CRITERIA = {
    "water": ["compliance monitoring", "regulatory requirements", "water quality control",
              "treatment process", "remote monitoring", "data logging", "epa compliance", "water safety",
              "chlorination", "water testing", "backflow prevention"],
    "agriculture": ["complex irrigation", "multiple water sources", "water conservation",
                    "irrigation automation", "remote field monitoring", "precision agriculture",
                    "water management", "crop monitoring", "soil moisture", "sprinkler control"],
    "healthcare": ["legionella", "legionella prevention", "water safety plan", "monitoring",
                   "patient safety", "hospital compliance", "water management program",
                   "temperature monitoring", "disinfection", "healthcare compliance"],
    "emergency": ["alerting system", "emergency response", "critical infrastructure",
                  "public notification", "resilience planning", "backup systems", "emergency management",
                  "critical operations", "alert notification"],
}
GENERAL_KEYWORDS = [
    "scada", "control system", "automation", "plc", "hmi", "industrial control", "instrumentation",
    "process control", "telemetry", "remote monitoring", "water treatment", "wastewater", "pump station",
    "RTU", "ICS",
]

TYPE_MULTIPLIER = {
    "water": 1.0, "wastewater": 1.0, "utility": 0.95, "oil_gas": 0.95, "agriculture": 0.9,
    "municipal": 0.9, "transportation": 0.85, "engineering": 0.75, "government": 0.75, "healthcare": 0.7,
}

TARGET_TITLES = {
    "water": [
        "Water Operations Manager", "Treatment Plant Director", "Plant Manager", "Operations Manager",
        "Water Quality Manager", "Compliance Manager", "Systems Manager", "Process Engineer",
        "Instrumentation Technician", "Chief Engineer", "Engineering Manager", "VP of Operations",
        "Director of Engineering", "Water Systems Director",
    ],
    "agriculture": [
        "Irrigation Manager", "Farm Operations Director", "District Manager", "Operations Manager",
        "Irrigation System Manager", "Agricultural Engineer", "Farm Technology Manager",
        "Water Resources Manager",
    ],
    "healthcare": [
        "Facilities Director", "Hospital Engineer", "Safety Officer", "Director of Plant Operations",
        "Maintenance Manager", "Compliance Officer", "Environmental Services Director",
        "Water Safety Manager",
    ],
    "emergency": [
        "Emergency Manager", "Operations Director", "Critical Infrastructure Manager",
        "Public Safety Director", "Emergency Services Coordinator", "Disaster Response Manager",
        "Systems Administrator", "Technical Operations Manager",
    ],
}
INDUSTRY_ROLE_WORDS = {
    "water": ["water operations", "treatment", "plant", "compliance", "quality", "water systems",
              "utility", "operations", "water"],
    "agriculture": ["irrigation", "farm operations", "agricultural", "water resources", "field", "farm",
                    "crop"],
    "healthcare": ["facilities", "engineering", "safety", "plant operations", "maintenance", "hospital",
                   "environmental", "compliance"],
    "emergency": ["emergency", "operations", "critical", "public safety", "disaster", "response",
                  "management", "systems"],
}
GENERAL_ROLE_WORDS = [
    "manager", "director", "engineer", "supervisor", "chief", "head", "lead", "administrator",
    "coordinator", "scada", "control", "automation", "operations", "technical", "maintenance",
    "project", "systems", "technology",
]

ROLE_WEIGHTS = {
    "water": 10, "utility": 9, "operations": 9, "public works": 8, "director": 8, "manager": 7,
    "supervisor": 7, "superintendent": 7, "engineer": 8, "maintenance": 7, "facilities": 7,
    "treatment": 9, "plant": 8, "systems": 8, "technology": 7, "infrastructure": 8, "technical": 7,
    "services": 6, "administrator": 6, "inspector": 6, "it ": 6, "information technology": 6,
    "development": 6, "planning": 6,
}
LEADERSHIP_WORDS = ["director", "manager", "supervisor", "chief", "head", "lead"]

TITLE_CLASSES = [
    (9.0, ["director", "manager", "chief", "superintendent", "administrator", "mayor", "president"]),
    (8.0, ["supervisor", "foreman", "lead", "senior", "coordinator", "engineer", "technician"]),
    (7.0, ["operator", "specialist", "analyst", "officer", "clerk", "secretary"]),
]
DEPARTMENT_BONUS = [
    (1.0, ["public works", "utilities", "water", "wastewater", "infrastructure", "engineering", "operations"]),
    (0.5, ["maintenance", "technical", "facility", "planning", "development", "management"]),
]
POSITION_BONUS = [
    (1.0, ["water", "utility", "infrastructure", "public works", "operations", "maintenance", "facilities"]),
    (0.5, ["planning", "technical", "technology", "systems", "project", "compliance"]),
]

INFRASTRUCTURE_ROLE_WORDS = [
    "infrastructure", "facilities", "operations", "maintenance", "plant", "public works", "utility",
    "water", "wastewater", "treatment", "automation", "scada", "control", "systems", "process",
    "engineering", "production",
]
DECISION_MAKER_WORDS = [
    "director", "manager", "chief", "head", "president", "supervisor", "superintendent",
    "administrator", "commissioner",
]
TECHNICAL_ROLE_WORDS = [
    "engineer", "technician", "operator", "specialist", "analyst", "integrator", "developer",
    "programmer", "administrator", "architect",
]

INDUSTRY_TERMS = {
    "water": ["water treatment", "drinking water", "water quality", "water distribution", "water supply",
              "water system", "potable water", "wells", "groundwater"],
    "wastewater": ["wastewater", "sewage", "sewer", "effluent", "collection system",
                   "wastewater treatment", "lagoon", "clarifier"],
    "engineering": ["engineering services", "civil engineer", "design", "construction management",
                    "consulting", "professional services"],
    "government": ["government", "agency", "department", "regulatory", "public sector", "municipal",
                   "authority"],
    "utility": ["utility", "electric", "power", "energy", "grid", "distribution", "generation",
                "substation"],
    "transportation": ["transportation", "transit", "traffic", "railway", "airport", "highway", "roads"],
    "oil_gas": ["oil", "gas", "petroleum", "pipeline", "drilling", "wellhead", "extraction", "refinery"],
    "agriculture": ["agriculture", "farm", "irrigation", "crop", "soil", "field", "cultivation"],
    "healthcare": ["hospital", "medical", "healthcare", "patient", "clinic", "health system"],
}

TARGET_STATES = ["Utah", "Illinois", "Arizona", "Missouri", "New Mexico", "Nevada"]
# ---- end of fixed values --------------------------------------------------------------------
