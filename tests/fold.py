"""Row-at-a-time statement of the identity rule, for checking the set-based one."""

TIER = {"company_careers": 1, "generic": 1, "greenhouse": 2, "lever": 2}


def sequential(rows, jobs=(), refs=(), base=0):
    """``rows``: (seq, source, sid, url, raw, hash). Returns {seq: (job, is_new, promoted)}."""
    jobs = {j["job_id"]: dict(j) for j in jobs}
    refs = [dict(r) for r in sorted(refs, key=lambda r: r["ref_id"])]
    out = {}
    for seq, source, sid, url, raw, digest in sorted(rows):
        found = None
        if sid:
            found = min((r["job_id"] for r in refs if (r["source"], r["sid"]) == (source, sid)), default=None)
        if found is None and url:
            found = min((j for j, job in jobs.items() if job["url"] == url), default=None)
            if found is None:
                found = next((r["job_id"] for r in refs if r["raw"] == url), None)
        if found is None:
            found = next((j for j, job in jobs.items() if job["hash"] == digest), None)
        tier = TIER.get(source, 3)
        is_new, promoted = found is None, False
        if is_new:
            found = base + 1 + seq
            jobs[found] = {"job_id": found, "url": url, "hash": digest, "tier": tier}
        ref = next(
            (r for r in refs if (r["job_id"], r["source"], r["sid"]) == (found, source, sid or "")), None
        )
        if ref is None:
            refs.append({"job_id": found, "source": source, "sid": sid or "", "raw": raw, "ref_id": base + 1 + seq})
        elif raw is not None:
            ref["raw"] = raw
        if not is_new and tier < jobs[found]["tier"]:
            jobs[found].update(tier=tier, url=url)
            promoted = True
        out[seq] = (found, is_new, promoted)
    return out, jobs, refs
