from linkweave.functions.contacts import (coalesce_empty, confidence_label, confidence_of,
                                         confidence_pct, contact_key, is_found, nullif_empty,
                                         payer_of, with_contact_key)
from linkweave.functions.domains import (host_rev_to_domain, invalid_domains, loose_domain,
                                        py_strip, reverse_domain, url_to_domain, valid_domain)
from linkweave.functions.scores import authority_or_null, authority_score, derive_dr
from linkweave.functions.timekeys import as_of, bytes_to, month_of

__all__ = [
    "authority_or_null", "authority_score", "as_of", "bytes_to", "coalesce_empty",
    "confidence_label", "confidence_of", "confidence_pct", "contact_key", "derive_dr",
    "host_rev_to_domain", "invalid_domains", "is_found", "loose_domain", "month_of",
    "nullif_empty", "payer_of", "py_strip", "reverse_domain", "url_to_domain",
    "valid_domain", "with_contact_key",
]
