"""Metric and event registry: which raw metric names stand for which KPI or event."""

# Key, label, type, category, normalisation, (min, max), exact names, patterns, disabled.
METRICS = [
    ("kpi_cqi_dl", "CQI (DL)", "kpi", "PHY", "unitless", (0, 15), ["Radio.Lte.ServingCell[8].Stream[2].Cqi"],
     [r"(lte).*cqi", r"(dl).*cqi", r"(servingcell|pcell).*cqi", r"cqi\b"], False),
    ("kpi_mcs_dl", "DL MCS", "kpi", "PHY", "unitless", (0, 31), ["Radio.Lte.ServingCell[8].Pdsch.Stream[2].Mcs"],
     [r"(dl).*mcs", r"mcs.*(dl)", r"(pdsch|dlsch).*mcs"], False),
    ("kpi_mcs_ul", "UL MCS", "kpi", "PHY", "unitless", (0, 31), ["Radio.Lte.ServingCell[8].Pusch.Mcs"],
     [r"(ul).*mcs", r"mcs.*(ul)", r"(pusch|ulsch).*mcs"], False),
    ("kpi_modulation", "Modulation (DL/UL)", "kpi", "PHY", "unitless", None, ["Radio.Lte.ServingCell[8].Pdsch.Stream[2].Modulation"],
     [r"modulation", r"(dl|ul).*modulation", r"(pdsch|pusch).*modulation", r"(qam|qpsk)"], False),
    ("kpi_pmi", "PMI", "kpi", "MIMO/CA", "unitless", None, ["Radio.Lte.ServingCell[8].Pmi"],
     [r"\bpmi\b", r"precoding.*matrix.*indicator"], False),
    ("kpi_bler_dl", "BLER DL", "kpi", "Reliability", "percent", (0, 100), ["Radio.Lte.ServingCell[8].Pdsch.Bler"],
     [r"(dl).*bler", r"(pdsch|dlsch).*bler"], False),
    ("kpi_rank_layers", "Rank/Layers (feedback proxy)", "kpi", "MIMO/CA", "count", (0, None),
     ["Radio.Lte.ServingCell[8].Rank1.FeedbackCount", "Radio.Lte.ServingCell[8].Rank2.FeedbackCount",
      "Radio.Lte.ServingCell[8].Rank3.FeedbackCount", "Radio.Lte.ServingCell[8].Rank4.FeedbackCount"],
     [r"rank\d+\.feedbackcount", r"rank.*feedback"], False),
    ("kpi_pci", "Serving PCI", "kpi", "PHY", "unitless", (0, 1008), ["Radio.Lte.ServingCell[8].Pci"],
     [r"\bpci\b", r"physical.*cell.*id"], False),
    ("kpi_earfcn", "EARFCN", "kpi", "PHY", "unitless", (0, None), ["Radio.Lte.ServingCell[8].Earfcn", "Radio.Lte.Neighbor[64].Earfcn"],
     [r"earfcn", r"dl.*arfcn", r"frequency.*channel"], False),
    ("kpi_rrc_state", "RRC State", "kpi", "Events", "unitless", None, [],
     [r"statistics\.network\.lte\.rrcstate", r"\brrc\b.*state", r"rrc.*connected", r"rrc.*idle"], False),
    ("kpi_timing_advance", "Timing Advance", "kpi", "PHY", "unitless", (0, None), ["Radio.Lte.ServingCell[8].TimingAdvance"],
     [r"timing.*advance", r"\bta\b"], False),
    ("ev_handover", "HO Start/Complete", "event", "Events", "unitless", None,
     ["Radio.Lte.IntraFrequencyHandoverEvent", "Radio.Lte.InterFrequencyHandoverEvent"],
     [r"handover", r"\bho\b", r"intra.*freq.*ho", r"inter.*freq.*ho"], False),
    ("ev_a3a5", "A3/A5 event", "event", "Events", "unitless", None,
     ["rrc_recfg_a3a5_inferred", "rrc_recfg_a3a5_thresholds_inferred"],
     [r"event\s*a3", r"event\s*a5", r"a3\/a5", r"measurementreport", r"rrc_recfg_a3", r"rrc_recfg_a5", r"rrc_recfg_a3a5"], False),
    ("ev_pci_change", "Cell/PCI Change (inferred)", "event", "Events", "unitless", None, ["Radio.Lte.ServingCell[8].Pci"],
     [r"\bpci\b", r"physical.*cell.*id"], False),
    ("ev_earfcn_change", "EARFCN/Band Change (inferred)", "event", "Events", "unitless", None,
     ["Radio.Lte.ServingCell[8].Earfcn", "Radio.Lte.Neighbor[64].Earfcn"], [r"earfcn", r"dl.*arfcn", r"frequency.*channel"], False),
    ("ev_rrc_state", "RRC State Transition", "event", "Events", "unitless", None, [],
     [r"statistics\.network\.lte\.rrcstate", r"\brrc\b.*state"], False),
    ("ev_bearer", "Bearer / EPS Bearer", "event", "Events", "unitless", None,
     ["Message.Layer3.Esm.ActivateDefaultEpsBearerContextRequest"], [r"bearer", r"\beps\b.*bearer", r"esm.*activate"], False),
    ("ev_ta_jumps", "TA Jumps", "event", "Events", "unitless", None, ["Radio.Lte.ServingCell[8].TimingAdvance"],
     [r"timing.*advance", r"\bta\b"], False),
    ("kpi_noise_interference", "Noise / Interference", "kpi", "PHY", "dB", None, [], [r"noise", r"interfer", r"\bio\b", r"isr"], True),
    ("kpi_tbs", "Transport Block Size (TBS)", "kpi", "PHY", "count", None, [], [r"\btbs\b", r"transport.*block.*size"], True),
    ("kpi_code_rate", "Code Rate", "kpi", "PHY", "percent", None, [], [r"code.*rate", r"coderate"], True),
    ("kpi_ca_status", "CA Status", "kpi", "MIMO/CA", "unitless", None, [], [r"carrier.*aggregation", r"num.*scell"], True),
    ("kpi_dl_prb_used", "DL PRB/RB Used", "kpi", "Scheduling", "count", None, [], [r"(dl|downlink).*(prb|rb)"], True),
    ("kpi_ul_prb_used", "UL PRB/RB Used", "kpi", "Scheduling", "count", None, [], [r"(ul|uplink).*(prb|rb)"], True),
    ("kpi_harq_retx_dl", "HARQ Retransmissions DL", "kpi", "Reliability", "count", None, [], [r"(dl).*(harq).*(retrans|retx)"], True),
    ("kpi_harq_retx_ul", "HARQ Retransmissions UL", "kpi", "Reliability", "count", None, [], [r"(ul).*(harq).*(retrans|retx)"], True),
    ("kpi_bler_ul", "BLER UL", "kpi", "Reliability", "percent", None, [], [r"(ul).*bler"], True),
    ("kpi_rlc_retx", "RLC Retransmissions", "kpi", "Reliability", "count", None, [], [r"\brlc\b.*(retrans|retx)"], True),
    ("kpi_pdcp_discard", "PDCP Discard / Reordering", "kpi", "Reliability", "count", None, [], [r"\bpdcp\b.*(discard|drop)"], True),
    ("kpi_packet_loss", "Packet Loss", "kpi", "TCP/IP", "percent", None, [], [r"packet.*loss", r"ip.*loss"], True),
    ("kpi_rtt", "RTT", "kpi", "TCP/IP", "ms", None, [], [r"\brtt\b", r"round.*trip"], True),
    ("kpi_tcp_retx", "TCP Retransmissions", "kpi", "TCP/IP", "count", None, [], [r"\btcp\b.*(retrans|retx)"], True),
    ("kpi_server_stall", "HTTP Stall / App Pause", "kpi", "TCP/IP", "ms", None, [], [r"http.*stall", r"app.*pause", r"ttfb"], True),
    ("kpi_tcp_window", "TCP CWND/RWND", "kpi", "TCP/IP", "count", None, [], [r"cwnd", r"rwnd"], True),
    ("kpi_jitter", "Jitter", "kpi", "TCP/IP", "ms", None, [], [r"jitter"], True),
    ("ev_rlf", "RLF", "event", "Events", "unitless", None, [], [r"rlf", r"radio.*link.*failure"], False),
    ("ev_rrc_reestab", "RRC Re-establishment", "event", "Events", "unitless", None, [], [r"re-?establishment", r"rrc.*reestab"], True),
    ("ev_scell_change", "CA SCell Add/Remove", "event", "Events", "unitless", None, [], [r"num.*scell", r"scell.*active"], True),
    ("ev_session_start_stop", "Data Session Start/Stop", "event", "Events", "unitless", None, [],
     [r"http.*(start|stop)", r"ftp.*(start|stop)", r"iperf.*(start|stop)"], True),
    ("ev_volte_call", "VoLTE Call Start/End", "event", "Events", "unitless", None, ["Call.Properties.VoLTESupport.Audio"],
     [r"volte", r"ims.*call", r"call.*(start|end)"], True),
    ("ev_drx_gap", "DRX / Measurement Gaps", "event", "Events", "unitless", None, [], [r"meas.*gap", r"\bdrx\b"], True),
]

# Scheduler fields; id, label, unit, exact names, patterns on the lower-cased name, needs per-TTI samples.
_SC, _ST = "Radio.Lte.ServingCell[8]", "Radio.Lte.ServingCellTotal"
SCHEDULER_FIELDS = [
    ("allocated_rb_dl", "Allocated RBs DL", "RB",
     [f"{_SC}.Pdsch.NumberOfResourceBlocks", f"{_ST}.Pdsch.NumberOfResourceBlocks", f"{_SC}.Pdsch.AllocatedPrb",
      f"{_ST}.Pdsch.AllocatedPrb", f"{_SC}.AllocatedRbs", f"{_ST}.AllocatedRbs"],
     [r"pdsch.*(numberofresourceblocks|allocated(prb|rb))", r"(allocated(prb|rb)).*pdsch"], True),
    ("allocated_rb_ul", "Allocated RBs UL", "RB",
     [f"{_SC}.Pusch.NumberOfResourceBlocks", f"{_ST}.Pusch.NumberOfResourceBlocks", f"{_SC}.Pusch.AllocatedPrb",
      f"{_ST}.Pusch.AllocatedPrb"],
     [r"pusch.*(numberofresourceblocks|allocated(prb|rb))", r"(allocated(prb|rb)).*pusch"], True),
    ("tbs_dl", "TBS DL", "bytes",
     [f"{_SC}.Pdsch.Tbs", f"{_ST}.Pdsch.Tbs", f"{_SC}.Pdsch.TransportBlockSize", f"{_ST}.Pdsch.TransportBlockSize"],
     [r"pdsch.*(tbs|transportblocksize)", r"(tbs|transportblocksize).*pdsch"], True),
    ("tbs_ul", "TBS UL", "bytes",
     [f"{_SC}.Pusch.Tbs", f"{_ST}.Pusch.Tbs", f"{_SC}.Pusch.TransportBlockSize", f"{_ST}.Pusch.TransportBlockSize"],
     [r"pusch.*(tbs|transportblocksize)", r"(tbs|transportblocksize).*pusch"], True),
    ("harq_process", "HARQ process counters", "count", [f"{_SC}.Harq.ProcessId", f"{_ST}.Harq.ProcessId"],
     [r"harq.*process", r"process.*harq"], False),
    ("harq_retx", "HARQ retransmissions", "count", [f"{_SC}.Harq.Retransmissions", f"{_ST}.Harq.Retransmissions"],
     [r"harq.*(retx|retrans|nack|fail)", r"(retx|retrans).*(harq)"], False),
    ("mac_retx", "MAC retransmissions", "count", [f"{_SC}.Mac.Retransmissions", f"{_ST}.Mac.Retransmissions"],
     [r"\bmac\b.*(retx|retrans|retransmission|nack|harq)"], False),
    ("rlc_retx", "RLC retransmissions", "count", [f"{_SC}.Rlc.Retransmissions", f"{_ST}.Rlc.Retransmissions"],
     [r"\brlc\b.*(retx|retrans|retransmission|am)"], False),
]

# Candidate metrics per KPI, best first.
KPI_CANDIDATES = {
    "rsrp": ["Radio.Lte.ServingCell[0].Rsrp", "Radio.Lte.ServingCell[8].Rsrp", "Radio.Lte.ServingCellTotal.Rsrp"],
    "rsrq": ["Radio.Lte.ServingCell[0].Rsrq", "Radio.Lte.ServingCell[8].Rsrq", "Radio.Lte.ServingCellTotal.Rsrq"],
    "sinr": ["Radio.Lte.ServingCell[0].RsSinr", "Radio.Lte.ServingCell[8].RsSinr", "Radio.Lte.ServingCellTotal.RsSinr"],
    "dl_tp": ["Pocket.Data.Downlink.Throughput", "Radio.Lte.ServingCellTotal.Pdsch.Throughput"],
    "ul_tp": ["Pocket.Data.Uplink.Throughput", "Radio.Lte.ServingCellTotal.Pusch.Throughput"],
}

# Throughput signals; exact name 100, contained text 70, pattern 60.
THROUGHPUT_SIGNALS = {
    "dl_radio": ("radio.lte.servingcelltotal.pdsch.throughput", "pdsch.throughput", r"radio\..*downlink.*throughput"),
    "ul_radio": ("radio.lte.servingcelltotal.pusch.throughput", "pusch.throughput", r"radio\..*uplink.*throughput"),
    "dl_app": ("data.http.download.throughput", "http.download.throughput",
               r"(data\.)?(http|ftp|iperf).*?(download|downlink|dl).*?(throughput|bitrate|thp)"),
    "ul_app": ("data.http.upload.throughput", "http.upload.throughput",
               r"(data\.)?(http|ftp|iperf).*?(upload|uplink|ul).*?(throughput|bitrate|thp)"),
}
DRIVERS = (r"(?i)(sinr|snr|rsrp|rsrq|cqi|mcs|\bri\b|layers|rank|prb|\brb\b|resource\s*block|bler|harq|rlc.*retx|"
           r"pdcp.*discard)")

# Keywords that become tags of a metric name.
TAGS = ["RSRP", "SINR", "MOS", "VOLTE", "IMS", "RTP", "RSRQ", "BLER", "RSCP", "ECNO", "CALL"]

# Key spellings (lower case, single blanks) to display names.
CANONICAL = {
    "cell id": "Cell ID", "cellid": "Cell ID", "cid": "Cell ID", "rnc": "RNC", "lac": "LAC", "freq": "Freq", "ecno": "EcNo",
    "rssi": "RSSI", "ue tx power": "UE Tx Power", "nodeb tx power": "NodeB Tx Power", "bler dl": "BLER DL",
    "bler ul": "BLER UL", "rrc state": "RRC State", "ho command": "HO Command", "ho completion": "HO Completion",
    "as event": "AS Event", "active set size": "Active Set Size", "as size": "Active Set Size", "tpc": "TPC",
    "serving rscp": "Serving RSCP", "serving sc": "Serving SC", "serving ecno": "Serving EcNo", "serving rnc": "Serving RNC",
    "serving lac": "Serving LAC", "serving freq": "Serving Freq", "serving rsrp": "Serving RSRP",
    "serving rsrq": "Serving RSRQ", "serving pci": "Serving PCI", "serving earfcn": "Serving EARFCN",
    "serving tac": "Serving TAC", "rsrp": "Serving RSRP", "rsrq": "Serving RSRQ", "pci": "Serving PCI",
    "earfcn": "Serving EARFCN", "tac": "Serving TAC",
}

# Keys that never become metrics.
EXCLUDED_KEYS = ["lat", "lng", "time", "type", "parsed", "geometry", "properties", "event", "message", "timestamp", "tech",
                 "source", "details", "radioSnapshot"]

# Preset legends; inclusive bins (min, max, label) or categories.
LEGEND_BINS = {
    "kpi_cqi_dl": [(0, 3, "Poor (0–3)"), (4, 6, "Fair (4–6)"), (7, 9, "Good (7–9)"), (10, 12, "Very Good (10–12)"),
                   (13, 15, "Excellent (13–15)")],
    "kpi_mcs_dl": [(0, 5, "Very Low (0–5)"), (6, 10, "Low (6–10)"), (11, 15, "Medium (11–15)"), (16, 20, "High (16–20)"),
                   (21, 31, "Very High (21–31)")],
    "kpi_mcs_ul": [(0, 5, "Very Low (0–5)"), (6, 10, "Low (6–10)"), (11, 15, "Medium (11–15)"), (16, 20, "High (16–20)"),
                   (21, 31, "Very High (21–31)")],
    "kpi_timing_advance": [(0, 50, "Near (0–50)"), (51, 200, "Mid (51–200)"), (201, 500, "Far (201–500)"),
                           (501, 900, "Very Far (501–900)"), (901, 1282, "Extreme (901–1282)")],
    "kpi_bler_dl": [(0, 1, "Excellent (≤1%)"), (1, 5, "Good (1–5%)"), (5, 10, "OK (5–10%)"), (10, 20, "Poor (10–20%)"),
                    (20, 100, "Bad (>20%)")],
}
LEGEND_CATEGORIES = {
    "kpi_modulation": [("QPSK", "QPSK"), ("16QAM", "16QAM"), ("64QAM", "64QAM"), ("256QAM", "256QAM")],
    "kpi_rank_layers": [("1", "Rank 1"), ("2", "Rank 2"), ("3", "Rank 3"), ("4", "Rank 4")],
    "ev_handover": [("HO", "Handover")], "ev_pci_change": [("PCI", "PCI Change")], "ev_earfcn_change": [("EARFCN", "EARFCN Change")],
    "ev_rrc_state": [("RRC", "RRC State Change")], "ev_bearer": [("Bearer", "Bearer / EPS Bearer")], "ev_ta_jumps": [("TA", "TA Jump")],
}
LEGEND_DYNAMIC = ["kpi_pci", "kpi_earfcn"]

# Map thresholds; a value belongs to (min, max].
THRESHOLDS = {
    "level": [(-70, None, "Excellent ( > -70 )"), (-85, -70, "Good ( -85 to -70 )"), (-95, -85, "Fair ( -95 to -85 )"),
              (-105, -95, "Poor ( -105 to -95 )"), (None, -105, "Bad ( < -105 )")],
    "quality": [(-6, None, "Excellent ( > -6 )"), (-10, -6, "Good ( -10 to -6 )"), (-14, -10, "Fair ( -14 to -10 )"),
                (-18, -14, "Poor ( -18 to -14 )"), (None, -18, "Bad ( < -18 )")],
}
