"""Fixed values that results depend on: sampling constants, time limits, bucket rules, field contract."""

from __future__ import annotations

# Sampling.
SAMPLE_SEED = 20260504
SAMPLE_ALPHA = 0.5
SAMPLE_SIZES = {"validation": 1500, "discovery": 300}
SAMPLE_QUOTAS = {"rich": 0.65, "norm_only": 0.20, "sparse": 0.15}
SEED_PICK_QUOTAS = {"rich": 13, "norm_only": 4, "sparse": 3}

# Run ledger, in seconds.
CLOCK_SKEW_S = 300
HEARTBEAT_STALE_S = 90
ORPHAN_AFTER_S = 60
SCRUB_AFTER_S = 60

# Run states.
RUN_STATUSES = ("queued", "starting", "running", "completed", "failed", "cancelled", "timed_out", "quota_blocked")
TERMINAL_STATUSES = ("completed", "failed", "cancelled", "timed_out")
ACTIVE_STATUSES = ("queued", "starting", "running")
JOB_STATE_MAP = {"succeeded": "completed", "failed": "failed", "canceled": "cancelled", "internal_error": "failed"}

# Artifact names by output format; other formats fall back to md.
OUTPUT_FILES = {"md": "output.md", "csv": "output.csv", "json": "output.json", "txt": "output.txt"}

# Text limits, in characters, and the input cap in bytes.
SUMMARY_CHARS = 280
TOOL_RESULT_CHARS = 2000
RAW_LINE_CHARS = 500
ERROR_TAIL_CHARS = 3000
INPUT_MAX_BYTES = 50 * 1024 * 1024

# Provider buckets as (tier, label, network codes, name patterns).
BUCKETS = [
    (1, "IAE — ACI (Ateliers Chantiers d'Insertion)", ["aci"], []),
    (1, "IAE — EI (Entreprise d'Insertion)", ["ei"], []),
    (1, "IAE — ETTI (Entreprise Travail Temp. d'Insertion)", ["etti"], []),
    (1, "IAE — EATT", [], [r"\bEATT\b"]),
    (1, "EA (Entreprise Adaptée)", ["ea"], []),
    (1, "ESAT (handicap)", ["esat"], []),
    (1, "GEIQ", ["geiq"], []),
    (1, "PLIE", ["plie"], []),
    (1, "EPIDE", [], [r"\bEPIDE\b"]),
    (1, "E2C (École 2e Chance)", [], [r"\bE2C\b", r"[ée]cole\s+de\s+la\s+(?:deuxi|2)[èe]me\s+chance"]),
    (1, "APEC", [], [r"\bAPEC\b"]),
    (1, "Apprentis d'Auteuil", [], [r"apprentis\W{1,3}auteuil"]),
    (1, "Mission Locale", ["mission-locale"], [r"mission\s+locale"]),
    (1, "Cap Emploi", ["cap-emploi-reseau-cheops"], [r"cap\s+emploi"]),
    (1, "AFPA", ["afpa"], []),
    (1, "ADIE", ["adie"], []),
    (1, "CIDFF (droits femmes/familles)", ["cidff"], []),
    (1, "FJT (Foyers Jeunes Travailleurs)", ["residences-fjt"], []),
    (1, "SPIP (insertion/probation pénitentiaire)", ["spip"], []),
    (2, "Associations (générique, fallback nom)", [], [r"\bassociation\b"]),
    (2, "CHRS (hébergement / réinsertion sociale)", ["chrs"], []),
    (2, "CHU (hébergement urgence)", ["chu"], []),
    (2, "CADA (demandeurs d'asile)", ["cada"], []),
    (2, "CPH (provisoire hébergement)", ["cph"], []),
    (2, "Centre social (fallback nom)", [], [r"centre\s+social"]),
    (2, "Maison de quartier (fallback nom)", [], [r"maison\s+de\s+quartier"]),
    (3, "CCAS / CIAS", ["ccas-cias"], [r"\bCCAS\b", r"\bCIAS\b"]),
    (3, "CAF", ["caf"], []),
    (3, "France Services", ["france-service"], []),
    (3, "Conseillers numériques", ["conseillers-numeriques"], []),
    (3, "France Travail", ["france-travail"], []),
    (3, "Communes / Mairies", ["communes"], [r"\bmairie\b", r"\bcommune\s+de\b"]),
    (3, "Départements", ["departements"], [r"conseil\s+d[ée]partemental"]),
    (3, "Maisons des Solidarités", ["maisons-des-solidarites"], []),
    (3, "MDPH (autonomie)", ["maison-departementale-de-lautonomie"], []),
    (3, "CMP (médico-psychologique)", ["cmp"], []),
    (3, "Aidants Connect", ["aidants-connect"], []),
]

# The extraction record contract as (group, field, type, allowed values, minimum, maximum).
CONTRACT_VERSION = "v0.2"
CONTRACT = [
    ("publics_extended", "age_min", "int", None, 0, 120),
    ("publics_extended", "age_max", "int", None, 0, 120),
    ("publics_extended", "situation_familiale", "list",
     ["parent_isole", "famille_monoparentale", "famille_avec_enfants", "parent_d_eleve",
      "parent_d_enfant_situation_handicap", "famille_en_situation_de_precarite"], None, None),
    ("publics_extended", "minima_sociaux", "list",
     ["rsa", "aah", "ass", "aspa", "ata", "prime_activite", "minima_sociaux_non_specifie"], None, None),
    ("publics_extended", "statut_handicap", "list",
     ["adulte_situation_handicap", "rqth", "boe", "invalidite", "pch"], None, None),
    ("publics_extended", "protection_juridique", "list", ["tutelle", "curatelle"], None, None),
    ("publics_extended", "statut_principal", "enum",
     ["demandeur_emploi", "salarie", "travailleur_independant", "createur_repreneur_entreprise",
      "stagiaire_formation_professionnelle", "volontaire_service_civique", "etudiant", "retraite"], None, None),
    ("publics_extended", "demandeur_emploi_modalite", "list",
     ["indemnise", "non_indemnise", "longue_duree", "contrat_aide"], None, None),
    ("publics_extended", "type_contrat", "list",
     ["cdi", "cdd", "interim", "alternance", "saisonnier", "csp", "pec", "siae"], None, None),
    ("publics_extended", "secteur_activite", "list",
     ["prive_non_agricole", "agricole", "public", "spectacle"], None, None),
    ("publics_extended", "situation_administrative", "list",
     ["primo_arrivant", "signataire_cir", "refugie", "beneficiaire_protection_internationale",
      "beneficiaire_protection_subsidiaire", "beneficiaire_protection_temporaire_ukrainiens",
      "demandeur_asile", "ressortissant_hors_ue", "majeur", "mineur_emancipe"], None, None),
    ("publics_extended", "situation_hebergement", "list",
     ["sans_hebergement", "heberge", "parcours_de_rue"], None, None),
    ("publics_extended", "statut_jeune", "list",
     ["jeune_sortant_ase", "jeune_descolarise", "mineur_difficultes_familiales", "etudiant_boursier"], None, None),
    ("publics_extended", "qualificateurs", "list", ["femme", "senior", "habitant_qpv"], None, None),
    ("prerequis_extended", "inscription_france_travail_requise", "bool", None, None, None),
    ("prerequis_extended", "prescription_requise", "list",
     ["travailleur_social", "ofii", "prescripteur_generique", "auto_positionnement_accepte"], None, None),
    ("prerequis_extended", "plafond_ressources", "bool", None, None, None),
    ("prerequis_extended", "revenu_fiscal_max_eur_par_part", "int", None, 0, None),
    ("prerequis_extended", "mode_accueil_urgence", "bool", None, None, None),
    ("prerequis_extended", "residence_geographique", "list",
     ["france_hexagonale", "france_metropolitaine", "drom", "qpv", "departement_specifique",
      "commune_specifique"], None, None),
    ("prerequis_extended", "niveau_francais_cecrl_min", "enum",
     ["infra_a1_1", "a1_1", "a1", "a2", "b1", "b2"], None, None),
    ("prerequis_extended", "besoins_pedagogiques", "list",
     ["alphabetisation", "illettrisme", "lecture_ecriture", "fle", "fli", "asl", "competences_cles"], None, None),
]
