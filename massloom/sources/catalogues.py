"""Column catalogues of the supported reports."""

from __future__ import annotations

from .columns import ColumnGroup, exact, fix_ident_type, fix_positive, fix_ratio, scoped

PROTGROUPS_NA = ("", "NA", "NaN", "n. def.", "n.def.")
DIA_NA = ("", "Filtered")

# Source header (a pattern) and canonical name, by group.
PROTGROUPS = (
    ColumnGroup("protgroup", exact(
        ("id", "protgroup_id"), ("Protein IDs", "protein_acs"), ("Majority protein IDs", "majority_protein_acs"), ("Gene names", "gene_names"),
        ("Protein names", "protein_names"), ("Fasta headers", "fasta_headers"), ("Number of proteins", "n_proteins"), ("Score", "ident_score"), ("Q-value", "q_value"),
        ("Sequence length", "seqlen"), ("Sequence lengths", "seqlens"), ("Mol. weight [kDa]", "mol_weight_kDa"), ("Peptides", "n_peptides"),
        ("Razor + unique peptides", "n_peptides_unique_razor"), ("Unique peptides", "n_peptides_unique"), ("Sequence coverage [%]", "seqcov"),
        ("Unique + razor sequence coverage [%]", "seqcov_unique_razor"), ("Unique sequence coverage [%]", "seqcov_unique"), ("MS/MS count", "n_ms2"),
        ("(?:Potential )?contaminant", "is_contaminant"), ("Reverse", "is_reverse"), ("Only identified by site", "is_site_only_ident"),
    ), required=True, flags=("is_contaminant", "is_reverse", "is_site_only_ident")),
    ColumnGroup("intensity", ((r"^Intensity\s([LMH])(?:\s(.+))?$", r"Intensity.\2|\1"), (r"^Intensity(?:\s(.+))?$", r"Intensity.\1")), fix=fix_positive),
    ColumnGroup("LFQ", ((r"^LFQ [Ii]ntensity\s([LMH])(?:\s(.+))?$", r"LFQ_Intensity.\2|\1"), (r"^LFQ [Ii]ntensity(?:\s(.+))?$", r"LFQ_Intensity.\1")), fix=fix_positive),
    ColumnGroup("iBAQ", ((r"^iBAQ\s([LMH])(?:\s(.+))?$", r"iBAQ.\2|\1"), (r"^iBAQ(?:\s(.+))?$", r"iBAQ.\1")), fix=fix_positive),
    ColumnGroup("ratio", ((r"^Ratio\s", "Ratio."),), fix=fix_ratio),
    ColumnGroup("ident_type", ((r"^Identification\stype\s", "ident_type."),), fix=fix_ident_type),
)

EVIDENCE = (
    ColumnGroup("mschannel", exact(("Raw file", "rawfile"), ("Experiment", "msexperiment"), ("Fraction", "msfraction"), ("Labeling State", "label_state")), required=True),
    ColumnGroup("evidence", exact(
        ("id", "evidence_id"), ("Intensity", "intensity"), ("Score", "psm_score"), ("Delta score", "psm_score_delta"), ("Max intensity m/z 0", "max_intensity_mz0"), ("Type", "ident_type"),
        ("Match time difference", "mbr_time_diff"), ("Match m/z difference", "mbr_mz_diff"), ("Match q-value", "mbr_qvalue"), ("Match score", "mbr_score"), ("PIF", "PIF"), ("PEP", "psm_pvalue"),
        ("Combinatorics", "ptm_ncombs"),
    ), required=True),
    ColumnGroup("ret_time", exact(
        ("Retention time", "rt"), ("Retention length", "rt_len"), ("Calibrated retention time", "calib_rt"), ("Calibrated retention time start", "calib_rt_start"),
        ("Calibrated retention time finish", "calib_rt_finish"), ("Retention time calibration", "rt_calib"),
    )),
    ColumnGroup("peptide", exact(
        ("Peptide ID", "peptide_id"), ("Sequence", "peptide_seq"), ("Length", "peptide_len"), ("Missed cleavages", "n_miscleaved"), ("Proteins", "peptide_protein_acs"),
        ("Leading proteins", "lead_protein_acs"), ("Leading razor protein", "lead_razor_protein_ac"), ("Gene [Nn]ames", "gene_names"), ("Protein [Nn]ames", "protein_names"),
        ("Fasta headers", "fasta_headers"), ("Reverse", "is_reverse"), ("Potential contaminant", "is_contaminant"), ("Contaminant", "is_contaminant"), ("Protein group IDs", "protgroup_ids"),
    ), flags=("is_reverse", "is_contaminant")),
    ColumnGroup("pepmodstate", exact(("Peptide ID", "peptide_id"), ("Mod. peptide ID", "pepmod_id_mq"), ("Modifications", "modifs"), ("Modified sequence", "pepmod_seq"), ("Charge", "charge"))),
    ColumnGroup("ms", exact(
        ("m/z", "mz"), ("MS/MS m/z", "ms2_mz"), (r"Mass [Ee]rror \[ppm\]", "mass_error_ppm"), (r"Mass [Ee]rror \[Da\]", "mass_error_da"), (r"Uncalibrated [Mm]ass [Ee]rror \[ppm\]", "uncalib_mass_error_ppm"),
        (r"Uncalibrated [Mm]ass [Ee]rror \[Da\]", "uncalib_mass_error_da"), (r"Uncalibrated - Calibrated m/z \[Da\]", "delta_mz_da"), (r"Uncalibrated - Calibrated m/z \[ppm\]", "delta_mz_ppm"),
        ("MS/MS IDs", "ms2_ids"), ("Best MS/MS", "ms2_best_id"), ("AIF MS/MS IDs", "ms2_aif_ids"), ("MS/MS [Cc]ount", "n_ms2"), ("MS/MS [Ss]can [Nn]umber", "ms2_scanid"), ("Mass", "mass_da"),
        ("Resolution", "resolution"), ("Number of data points", "n_datapoints"), ("Number of scans", "n_scans"), ("Number of isotopic peaks", "n_isopeaks"),
        ("Fraction of total spectrum", "frac_total_spectrum"), ("Base peak fraction", "frac_base_peak"),
    )),
    ColumnGroup("aacount", ((r"^(\w) [Cc]ount$", r"aacount_\1"),)),
    ColumnGroup("pepmod_ptms", ((r"^(.+)\s\((.+)\)\ssite IDs", r"ptm_ids.\1"), (r"^(.+)\s\((.+)\)\sProbabilities", r"ptm_locprob_seq.\1"), (r"^(.+)\s\((.+)\)\sScore Diffs", r"ptm_scorediff_seq.\1"))),
    ColumnGroup("intensity", ((r"^Intensity (.+)", r"intensity.\1"),), fix=fix_positive),
)

DIA = (
    ColumnGroup("quantity", scoped((r"\.Quantity", "intensity"), (r"\.TotalQuantity \(Settings\)", "intensity"), (r"\.NormalizationFactor", "normfactor"), (r"\.Qvalue", "qvalue"))),
    ColumnGroup("properties", scoped(("IsSingleHit", "is_singlehit"))),
    ColumnGroup("ident_stats", scoped(
        (r"\.RunEvidenceCount", "nevidences"), (r"\.NrOfStrippedSequencesMeasured", "npeptides_quanted"), (r"\.NrOfStrippedSequencesIdentified", "npeptides_idented"),
        (r"\.NrOfModifiedSequencesMeasured", "npepmods_quanted"), (r"\.NrOfModifiedSequencesIdentified", "npepmods_idented"), (r"\.NrOfPrecursorsIdentified", "npepmodstates_idented"),
    )),
    ColumnGroup("protgroup", scoped(
        ("PG.ProteinGroups", "protgroup_sn_id"), ("PG.ProteinAccessions", "majority_protein_acs"), ("PG.UniProtIds", "majority_protein_acs_alt"), ("PG.Genes", "gene_names"),
        ("PG.ProteinNames", "protein_names"), ("PG.ProteinDescription", "protein_descriptions"), ("PG.Organisms", "organisms"), ("PG.Qvalue", "qvalue"),
    ), required=True),
    ColumnGroup("pepmodstate", scoped(("EG.PrecursorId", "pepmodstate_seq"), ("EG.ModifiedSequence", "pepmod_seq"), ("EG.IsDecoy", "is_decoy")), flags=("is_decoy",)),
    ColumnGroup("peptide", scoped(("PEP.PeptidePosition", "peptide_poses"), ("PEP.IsProteinGroupSpecific", "is_specific_peptide"), ("PEP.AllOccurringProteinAccessions", "peptide_protein_acs")), flags=("is_specific_peptide",)),
    ColumnGroup("msrun", scoped(("R.FileName", "rawfile"), ("R.Replicate", "msrun_ix")), required=True),
    ColumnGroup("metrics", scoped((r"\.PTMLocalizationProbabilities", "locprob_seq"))),
)

# Identification types, from the most to the least confident.
EVIDENCE_TYPES = ("ISO-MSMS", "MULTI-MSMS", "MSMS", "MULTI-SECPEP", "MULTI-MATCH", "MULTI-MATCH-MSMS")

# Site annotation files and their columns.
SITE_FILES = {
    "KinaseSubstrate": "Kinase_Substrate_Dataset", "DiseaseAssoc": "Disease-associated_sites", "PhosphoSites": "Phosphorylation_site_dataset", "UbiSites": "Ubiquitination_site_dataset",
    "RegSites": "Regulatory_sites",
}
SITE_COLUMNS = {
    "GENE": "gene_name", "SUB_GENE": "gene_name", "PROTEIN": "protein_name", "KINASE": "kinase_protein_name", "SUBSTRATE": "protein_name", "ACC_ID": "protein_ac",
    "KIN_ACC_ID": "kinase_protein_ac", "SUB_ACC_ID": "protein_ac", "GENE_ID": "entrez_id", "SUB_GENE_ID": "entrez_id", "SITE_GRP_ID": "psitep_sitegroup_id", "ORGANISM": "organism",
    "KIN_ORGANISM": "kinase_organism", "SUB_ORGANISM": "organism", "SITE_+/-7_AA": "flanking_AAs", "DOMAIN": "domain", "DISEASE": "disease",
}
SITE_OVERRIDES = {
    "KinaseSubstrate": {"GENE": "kinase_gene_name"},
    "RegSites": {"ON_FUNCTION": "reg_function", "ON_PROT_INTERACT": "reg_prot_iactions", "ON_OTHER_INTERACT": "reg_other_iactions", "PMIDs": "reg_pubmed_ids"},
    "DiseaseAssoc": {"PMIDs": "disease_pubmed_ids"},
}
