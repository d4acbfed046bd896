"""Fourteen postings and what one run over them must give (FIXTURES.md, section 4)."""

from rolecall.config import SearchConfig

CONFIG = SearchConfig(
    roles=(
        "software engineer", "sde", "backend engineer", "full stack engineer", "software developer",
        "data analyst", "senior data analyst", "data engineer", "genai engineer",
        "generative ai engineer", "ml engineer", "machine learning engineer",
    ),
    locations=("Bangalore", "Bengaluru", "Hyderabad", "Chennai", "Mumbai", "Gurgaon", "Pune", "Remote"),
    location_aliases={
        "Bangalore": ("Bengaluru",), "Bengaluru": ("Bangalore",), "Mumbai": ("Bombay",),
        "Gurgaon": ("Gurugram",), "Delhi": ("New Delhi",),
    },
    experience_min=3,
    experience_max=6,
    skills=("Python", "Node.js", "React", "SQL", "Azure"),
    preferred_skills=("GenAI", "RAG", "LLM", "FastAPI", "Microservices", "Power BI"),
    excluded_keywords=("internship", "director", "vice president"),
    employment_types=("full_time", "contract"),
)


def _row(source, sid, company, title, url, location, low, high, text, skills, **more):
    domain = company.lower().replace(" ", "") + ".test"
    row = {
        "source": source, "source_job_id": sid, "company_name": company, "company_domain": domain,
        "title": title, "url": f"https://{domain}/{url}", "location": location, "experience_min": low,
        "experience_max": high, "description": text, "skills": skills,
        "employment_type": "Full-time", "posted_date": "2026-10-04",
    }
    row.update(more)
    return {k: v for k, v in row.items() if v is not None}


FX, WEB = "fixture", "fixture_web"
ROWS = [
    _row(FX, "g-01", "Larch Cloud", "Senior Backend Engineer", "jobs/1", "Bangalore, India", 3, 5,
         "Python services and FastAPI endpoints over SQL stores.", ["Python", "FastAPI", "SQL"],
         remote_status="hybrid"),
    _row(WEB, "w-01", "Larch Cloud", "Senior Backend Engineer", "jobs/1?utm_source=copy", "Bangalore, India",
         3, 5, "Python services and FastAPI endpoints.", ["Python", "FastAPI", "SQL"], remote_status="hybrid"),
    _row(FX, "g-03", "Tern Data", "Software Engineer II", "jobs/3", "Hyderabad, India", "2", "4",
         "Pipelines in Python and SQL.", "Python; SQL", posted_date="2026-10-05"),
    _row(FX, "g-04", "Wren Health", "Backend Engineer (Python)", "jobs/4", "Remote", 3, 5,
         "Microservices for clinics: Python, SQL. FastAPI is welcome.", ["Python", "SQL"],
         remote_status="remote", posted_date="2026-10-01"),
    _row(WEB, "w-04", "Wren Health", "Backend Engineer (Python)", "jobs/4?ref=copy", "Remote", 3, 5,
         "Microservices for clinics: Python, SQL.", ["Python", "SQL"], remote_status="remote",
         posted_date="2026-10-01"),
    _row(FX, "g-05", "Finch Retail", "Software Development Engineer (SDE 2)", "jobs/5", "Pune, India", 2, 4,
         "Checkout in Python on SQL.", ["Python", "SQL"], posted_date="2026-09-30"),
    _row(FX, "g-06", "Heron Freight", "Software Intern", "jobs/6", "Bangalore, India", 0, 1,
         "Help with Python scripts.", ["Python"], employment_type="Internship", posted_date="2026-10-02"),
    _row(FX, "g-07", "Plover Insight", "Director of Engineering", "jobs/7", "Mumbai, India", 10, 15,
         "Lead the teams.", [], posted_date="2026-09-29"),
    _row(FX, "g-08", "Osprey Learning", "Backend Engineer", "jobs/8", "Chennai, India", 2, 5,
         "Course APIs with Python and SQL.", ["Python", "SQL"], posted_date="2026-10-03"),
    _row(FX, "g-09", "Larch Cloud", "Python Developer", "jobs/9", "Bangalore, India", 1, 3,
         "Tools in Python, SQL every day.", ["Python", "SQL"], employment_type="Contract",
         posted_date="2026-09-28"),
    _row(FX, "g-10", "Tern Data", "Software Engineer", "jobs/10", "Remote", None, None,
         "Build dependable systems.", [], remote_status="remote", employment_type=None, posted_date=None),
    _row(FX, "g-12", "Zephyr Works", "Backend Engineer", "jobs/12", "Bangalore, India", 3, 5,
         "Python and SQL.", ["Python", "SQL"]),
    _row(FX, "g-13", "Larch Cloud", "Vice President of Engineering", "jobs/13", "Mumbai, India", 12, 18,
         "Own the strategy.", [], posted_date="2026-10-01"),
    _row(FX, "g-14", "Wren Health", "FastAPI Engineer", "jobs/14", "Hyderabad, India", 4, 6,
         "Fast APIs: Python, SQL.", ["FastAPI", "Python", "SQL"], posted_date="2026-10-05"),
]

ENTITIES = [
    ("Larch Cloud", "larchcloud.test", "C"), ("Tern Data", "terndata.test", "C"),
    ("Wren Health", "wrenhealth.test", "C"), ("Finch Retail", "finchretail.test", "C"),
    ("Heron Freight", "heronfreight.test", "C"), ("Plover Insight", "ploverinsight.test", "C"),
    ("Osprey Learning", "ospreylearning.test", "C"),
]

#: id -> (reject reason, score)
OUTCOMES = {
    "g-01": (None, 79), "g-03": (None, 78), "g-04": (None, 81), "g-05": (None, 78),
    "g-06": ("Experience 0-1 yrs outside 3-6 yrs", None),
    "g-07": ("Excluded keyword: director", None),
    "g-08": (None, 78), "g-09": (None, 66),
    "g-10": ("Only 0/1 required skills matched", None),
    "g-12": ("Not a target company", None),
    "g-13": ("Excluded keyword: vice president", None),
    "g-14": (None, 67),
}
RANKED = ["g-04", "g-01", "g-03", "g-08", "g-05", "g-14", "g-09"]
