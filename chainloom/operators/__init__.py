"""

Ids whose work is Spark's own name what does it.
"""

INDEX: dict[str, tuple[str, str]] = {
    "A1": ("sources.nodes", "NodeSource, Client.calls"),
    "A2": ("sources.nodes", "NodeSource transport=rest"),
    "A3": ("sources.nodes", "NodeReader.partitions"),
    "A4": ("sources.snapshots", "SnapshotSource"),
    "A5": ("sources.files", "price_series"),
    "A6": ("sources.files", "strict_csv, numbered_csv"),
    "A7": ("plans.store", "Store.read: Parquet scan"),
    "A8": ("cli", "Data: Parquet scan with a height predicate"),
    "A9": ("plans.audit", "headers_of"),
    "A10": ("cli", "ingest build"),
    "A11": ("plans.ingest", "parsed"),
    "A12": ("streaming.ingest", "ingest"),
    "A13": ("plans.reveal", "sightings: reduced before the shuffle"),
    "A14": ("plans.store", "Store.commit: Spark's sort spills"),
    "A15": ("sources.files", "write_csv"),
    "A16": ("sources.files", "write_json, write_text"),
    "A17": ("streaming.ingest", "ingest: one parse, several sinks"),
    "A18": ("plans.audit", "interval_digests, compared_digests"),
    "A19": ("sources.nodes", "Client.times, kind=header"),
    "A20": ("sources.nodes", "Client.balances"),
    "A21": ("sources.nodes", "credentials"),
    "B1": ("sources.parse", "Reader.size, compact"),
    "B2": ("functions.chain", "header_fields"),
    "B3": ("sources.parse", "transaction"),
    "B4": ("sources.parse", "block"),
    "B5": ("plans.audit", "merkle_root"),
    "B6": ("sources.parse", "transaction: coinbase"),
    "B7": ("functions.scripts", "pushes_of, script_pushes"),
    "B8": ("plans.ingest", "Tables.reveals: null where malformed"),
    "B9": ("functions.hashing", "hash_hex"),
    "B10": ("functions.hashing", "sha256d"),
    "B11": ("functions.hashing", "ripemd160, hash160"),
    "B12": ("functions.chain", "looks_like_pubkey"),
    "B13": ("sources.snapshots", "amount_of; functions.chain.decompress_amount"),
    "B14": ("functions.chain", "classify_script"),
    "B15": ("functions.chain", "epoch_index"),
    "B16": ("functions.chain", "height_band"),
    "B17": ("functions.chain", "subsidy_at"),
    "B18": ("functions.chain", "bip34_height"),
    "B19": ("functions.chain", "header_bytes, header_fields"),
    "B20": ("functions.scripts", "der_parts"),
    "B21": ("functions.scripts", "canonical"),
    "B22": ("functions.scripts", "schnorr_parts"),
    "B23": ("functions.scripts", "schnorr_slots"),
    "B24": ("functions.chain", "sighash_bits, sighash_of"),
    "B25": ("functions.chain", "tiny"),
    "B26": ("plans.nonces", "resolutions: impossible"),
    "B27": ("functions.scripts", "decode, decode_address"),
    "B28": ("functions.chain", "script_pubkey"),
    "B29": ("functions.chain", "canonical_price"),
    "B30": ("functions.chain", "price_micro"),
    "B31": ("functions.chain", "utc_date"),
    "B32": ("functions.chain", "coins"),
    "B33": ("functions.chain", "flag_words"),
    "B34": ("functions.chain", "runs"),
    "B35": ("plans.nonces", "columns in place of packed records"),
    "C1": ("plans.ingest", "Tables.reveals"),
    "C2": ("plans.lookups", "spent_between"),
    "C3": ("plans.lookups", "spent_between"),
    "C4": ("plans.lookups", "history, digests, points"),
    "C5": ("plans.reveal", "within"),
    "C6": ("plans.nonces", "groups"),
    "C7": ("cli", "price daily"),
    "C8": ("plans.ledger", "rewind"),
    "C9": ("plans.nonces", "candidate_inputs"),
    "C10": ("plans.lookups", "hex_bytes, outpoints"),
    "D1": ("plans.ledger", "ordinals"),
    "D2": ("plans.ingest", "tables"),
    "D3": ("plans.ledger", "height_of"),
    "D4": ("plans.lookups", "outputs"),
    "D5": ("cli", "every verb's order"),
    "D6": ("plans.lookups", "history limit"),
    "D7": ("plans.ledger", "stats_by_bucket"),
    "E1": ("plans.ledger", "resolve"),
    "E2": ("plans.ledger", "txid_index"),
    "E3": ("plans.ledger", "spenders"),
    "E4": ("plans.ledger", "history"),
    "E5": ("plans.ledger", "spend_heights"),
    "E6": ("plans.reveal", "burned"),
    "E7": ("plans.reveal", "exposure"),
    "E8": ("plans.reveal", "opened"),
    "E9": ("plans.series", "asof"),
    "E10": ("plans.series", "asof_first"),
    "E11": ("plans.links", "cospends"),
    "E12": ("plans.links", "co_inputs"),
    "E13": ("plans.links", "common_input"),
    "E14": ("plans.links", "through_bridge, hubs"),
    "E15": ("plans.links", "payment_arcs"),
    "E16": ("plans.links", "same_key"),
    "E17": ("plans.links", "separations"),
    "E18": ("plans.lookups", "lock_signatures"),
    "E19": ("plans.nonces", "own_repeats: elsewhere"),
    "E20": ("plans.audit", "differences"),
    "E21": ("plans.audit", "merkle_mismatches"),
    "E22": ("plans.audit", "chain_breaks"),
    "E23": ("plans.ledger", "fiat_fees"),
    "E24": ("plans.check", "Report.crossing"),
    "F1": ("plans.reveal", "reduced"),
    "F2": ("plans.reveal", "lock_totals"),
    "F3": ("plans.census", "by_band, by_epoch, totals"),
    "F4": ("plans.ledger", "block_stats"),
    "F5": ("plans.ledger", "stats_by_bucket"),
    "F6": ("plans.ledger", "fees"),
    "F7": ("plans.ledger", "balances, balance_at"),
    "F8": ("plans.ledger", "summary"),
    "F9": ("plans.audit", "ledger_identities"),
    "F10": ("plans.ledger", "first_spend"),
    "F11": ("plans.nonces", "groups"),
    "F12": ("plans.nonces", "tallies"),
    "F13": ("plans.nonces", "witness, witness_rows"),
    "F14": ("plans.nonces", "resolutions"),
    "F15": ("plans.nonces", "own_repeats"),
    "F16": ("plans.ledger", "supply, supply_by_bucket"),
    "F17": ("plans.ledger", "fiat_fees"),
    "F18": ("plans.series", "daily"),
    "F19": ("plans.series", "window_counts"),
    "F20": ("plans.check", "Report.summary"),
    "F21": ("plans.store", "total_cost"),
    "F22": ("queries", "slot_count"),
    "F23": ("plans.nonces", "unknown_items"),
    "F24": ("plans.nonces", "extraction_stats"),
    "G1": ("plans.dist", "gini_parts, gini_of"),
    "G2": ("plans.dist", "order_stats: nearest rank"),
    "G3": ("plans.dist", "order_stats"),
    "G4": ("plans.dist", "top_n, top_fraction"),
    "G5": ("plans.dist", "tail_from"),
    "G6": ("plans.dist", "lorenz"),
    "G7": ("plans.dist", "level_histogram"),
    "G8": ("cli", "reuse stats"),
    "G9": ("plans.dist", "concentration"),
    "H1": ("plans.series", "deltas"),
    "H2": ("plans.series", "last_line"),
    "H3": ("plans.series", "cumulative"),
    "H4": ("plans.series", "median_time_past"),
    "H5": ("plans.series", "daily"),
    "H6": ("plans.ledger", "ordinals"),
    "H7": ("plans.ledger", "events, running_balance"),
    "H8": ("plans.series", "in_order"),
    "H9": ("plans.series", "lengths"),
    "I1": ("plans.store", "Store.append"),
    "I2": ("plans.ledger", "txid_index"),
    "I3": ("queries", "points_missing"),
    "I4": ("plans.audit", "gaps"),
    "J1": ("streaming.ingest", "ingest"),
    "J2": ("plans.store", "Store.append"),
    "J3": ("plans.store", "Store.append with merge"),
    "J4": ("plans.ledger", "rewind; plans.store.Store.rewind"),
    "J5": ("plans.store", "Store.commit, Store.sweep"),
    "J6": ("plans.lookups", "with_pending"),
    "J7": ("plans.ingest", "linked"),
    "J8": ("plans.series", "rewritten"),
    "J9": ("streaming.ingest", "matched"),
    "K1": ("plans.store", "identity_bytes, fingerprint"),
    "K2": ("plans.store", "statement_bytes, statement"),
    "K3": ("plans.audit", "content_digest"),
    "K4": ("plans.reveal", "bitmap, bitmap_fingerprint"),
    "K5": ("plans.store", "Store.verify"),
    "K6": ("plans.audit", "revelation_faults, nonce_faults"),
    "K7": ("plans.audit", "ledger_identities"),
    "K8": ("plans.lookups", "projection_digests"),
    "K9": ("plans.store", "Store.manifest: parent"),
    "K10": ("plans.store", "checked_name"),
    "K11": ("plans.store", "Clock, producer, report_page"),
    "K12": ("plans.lookups", "series_faults"),
    **{f"L{i}": ("cli", v) for i, v in enumerate("census|reuse|archive|nonces|headers|graph|index|derived|firstspend|blockstats|price|curve|check|report".split("|"), 1)},
    "L15": ("plans.check", "address_book"),
    "L16": ("plans.check", "check: nonces"),
    "L17": ("plans.lookups", "outputs"),
    "L18": ("plans.ledger", "history, events"),
    "L19": ("plans.ledger", "balance_at, fees; plans.links.cospends"),
    "L20": ("plans.reveal", "exposure; plans.nonces.resolutions"),
    "L21": ("functions.scripts", "decode; functions.chain.script_pubkey"),
    "L22": ("plans.lookups", "at_price, block_prices"),
    "L23": ("plans.store", "Store"),
    "L24": ("sources.nodes", "Client"),
}
